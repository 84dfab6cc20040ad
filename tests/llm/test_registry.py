"""The operators in llm/ are those that are registered."""

import importlib
import pkgutil
import re

import llm
from llm import registry


def test_one_implementation_of_each_operator():
    modules = [importlib.import_module(f"llm.{m.name}") for m in pkgutil.iter_modules(llm.__path__)]
    own = [(name, f) for m in modules for name, f in vars(m).items() if re.match(r"op\d+_", name) and f.__module__ == m.__name__]
    assert own and all(registry.QUERIES[name] is f for name, f in own)
