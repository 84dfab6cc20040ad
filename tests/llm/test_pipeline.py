"""The whole pipeline against one of plain loops, and the registry."""

import random
import re

import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from llm import bpe, langid, registry, suffix

from .conftest import SCHEMA, prose
from .test_minhash import components
from .test_text_operators import WORDS, hits


def corpus():
    rng = random.Random(21)
    said = lambda n, lang: " ".join(rng.choice(WORDS[lang].split()) + rng.choice("abcdefghij") for _ in range(n))
    passage = prose(rng, 60)
    item = said(14, "en")
    rows = [(i, said(rng.randint(30, 120), lang), lang, "s", 1) for i in range(120) for lang in [rng.choice(list(WORDS))]]
    rows += [(200 + i, rows[i][1], rows[i][2], "s", 1) for i in range(5)] + [(300 + i, said(60, "en") + " " + passage, "en", "s", 1) for i in range(6)]
    rows += [(400, said(30, "en") + " " + item + " " + said(30, "en"), "en", "s", 1), (401, "12 34", "en", "s", 1), (402, None, "en", "s", 1)]
    return rows, [(1, item)]


def test_pipeline_equals_loops(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = langid.train(docs)
    letters = lambda t: sum(c.isalpha() for c in t or "")
    known = {r["doc_id"] for r in langid.predict(docs, model).collect() if r["lang_pred"] != "und" and (r["lang_margin"] >= corpus_pipeline.MARGIN or letters(r["text"]) < corpus_pipeline.LETTERS)}
    left = [(d, t) for d, t, *_ in rows if d in known]
    kept = {d for d, _, _, k in components(left) if k}
    left = [(d, t) for d, t in left if d in kept]
    n = {}
    for _, t in left:
        b = t.encode()
        for i in range(len(b) - suffix.WINDOW + 1):
            n[b[i : i + suffix.WINDOW]] = n.get(b[i : i + suffix.WINDOW], 0) + 1
    cut = []
    for d, t in left:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - suffix.WINDOW + 1):
            if n[b[i : i + suffix.WINDOW]] > 1:
                gone[i : i + suffix.WINDOW] = b"\1" * suffix.WINDOW
        cut.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {d: enc.encode_ordinary(t) for d, t in cut if not hits([(d, t)], items)[0][2]}
    assert got == want
    assert 400 not in got and 401 not in got and 200 not in got and all(i in got for i in range(300, 306))


def test_stages_keep_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
        docs = docs.checkpoint()
    assert docs.count() > 0


def test_language_stage_rejects_only_what_it_has_no_opinion_on(spark, none):
    """Where two languages are learned from the same texts, long texts have no language; short ones and clean ones stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgk") + rng.choice("aou") for _ in range(3))
    alike = [" ".join(word() for _ in range(40)) for _ in range(40)]
    rows = [(2 * i + k, t, ("xx", "yy")[k], "s", 1) for i, t in enumerate(alike) for k in (0, 1)]
    clean = [(500 + i, " ".join(rng.choice(["the", "which", "there", "smell"]) for _ in range(n)), "en", "s", 1) for i, n in enumerate([1, 2, 5, *[40] * 40])]
    docs = spark.createDataFrame([*rows, *clean, (900, "bada gu", "xx", "s", 1), (901, "12 !", "xx", "s", 1), (902, None, "xx", "s", 1)], SCHEMA)
    left = corpus_pipeline.identify_language(spark, docs, "")
    ids = {r["doc_id"] for r in left.collect()}
    assert left.columns == docs.columns and {r[0] for r in clean} | {900} <= ids and not {901, 902} & ids
    assert {r[0] for r in rows} - ids
    assert corpus_pipeline.identify_language(spark, none, "").count() == 0
    one = spark.createDataFrame([(1, alike[0], "xx", "s", 1), (2, alike[1], "xx", "s", 1), (3, alike[2], "xx", "s", 1), (4, alike[3], "xx", "s", 1)], SCHEMA)
    assert corpus_pipeline.identify_language(spark, one, "").count() == 4


def test_empty_documents(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    names = entry.queries()
    assert [n.split("_")[0] for n in names if re.match(r"op\d+_", n)] == [f"op{i}" for i in range(1, 14)] and names["pipeline"] is corpus_pipeline.run
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(names) and all(entry.oracle_sql()[n] == s for n, s in registry.ORACLES.items())
    assert len(corpus_pipeline.STAGES) == 5
