"""Polls against loops: who joins whom, in order and in any, and what the postings make of a row."""

import datetime as dt
import random

import pytest

from postforge.operators import matching, polls

NOW = dt.datetime(2024, 5, 1)
JOB = "id long, arrival long, company_key string, title_key string, title_core_key string, description_fingerprint string, location_key string, region string, role_family string, work_mode string, posted_at timestamp, short_summary string, description string, apply_url_key string, source_url_key string, posting_id_key string, duplicate_cluster_id string"
MAP = "id long, canonical_id long, apply_url_key string, source_url_key string, posting_id_key string, removed_at timestamp, is_primary boolean, source_quality_rank int, last_seen_at timestamp"
KEYS = ("apply_url_key", "source_url_key", "posting_id_key", "duplicate_cluster_id")


def jobs(rng, n, first, hot=False):
    """Postings of few companies and titles, so that keys and texts meet often; arrival is no order of ids."""
    order = rng.sample(range(n), n)
    out = []
    for i in range(n):
        core = rng.choice(["data-engineer", "data-analyst-sales", "nurse", "data-analyst-ops", "night-nurse"])
        company, place = rng.choice(["acme", "acme", "globex", "unknown"]), rng.choice(["bonn", "graz", ""])
        key = lambda p, odds: "hot" if hot and rng.random() < 0.3 else f"{p}{rng.randrange(n)}" if rng.random() < odds else None
        words = rng.sample("alpha bravo charlie delta echoes foxtrot golfing hotels".split(), 5)
        out.append((first + i, order[i], company, core + rng.choice(["", "-senior"]), core, "-".join(words) if rng.random() < 0.7 else "", place, rng.choice(["US", "CA", None]), "SWE", rng.choice(["REMOTE", "ONSITE"]), NOW - dt.timedelta(days=rng.choice([0, 10, 60])), "", " ".join(words),
                    key("u", 0.3), key("s", 0.2), key("p", 0.2), f"{company}:{core}:{place}" if rng.random() < 0.5 else None))
    return out


def test_components(spark):
    rng = random.Random(4)
    for k in range(3):
        rows = jobs(rng, 80, 1, hot=k == 1)
        if k == 2:  # a chain
            rows = [(*r[:13], f"u{i // 2}", f"s{(i + 1) // 2}", None, None) for i, r in enumerate(rows)]
        label = {r[0]: r[0] for r in rows}
        for _ in range(len(rows)):
            for col in range(13, 17):
                by = {}
                for r in rows:
                    if r[col] is not None and (col != 16 or r[2] != "unknown"):
                        by.setdefault(r[col], []).append(r[0])
                for ids in by.values():
                    low = min(label[i] for i in ids)
                    label.update(dict.fromkeys(ids, low))
        got = polls.components(spark.createDataFrame(rows, JOB).repartition(3))
        assert {r["id"]: r["component"] for r in got.collect()} == label
    assert polls.components(spark.createDataFrame([], JOB)).count() == 0


def loop(postings, settled, maps, known, scores):
    """One posting after the other. scores[known or earlier id, new id] of all pairs that a comparison may see."""
    names = [c.split()[0] for c in JOB.split(", ")]
    rows = sorted((dict(zip(names, p, strict=True)) for p in postings), key=lambda r: r["arrival"])
    old = [dict(zip(names, p, strict=True)) for p in known]
    m = [dict(zip([c.split()[0] for c in MAP.split(", ")], x, strict=True)) for x in maps]
    ends, before = {}, []
    for r in rows:
        if r["id"] in settled:
            ends[r["id"]] = (settled[r["id"]], None, None)
        else:
            found = []
            for rung, key in ((0, KEYS[0]), (2, KEYS[1]), (4, KEYS[2])):
                own = [x for x in m if r[key] is not None and x[key] == r[key]]
                if own:
                    best = min(own, key=lambda x: (x["removed_at"] is None, x["removed_at"] or NOW, not x["is_primary"], -x["source_quality_rank"], -x["last_seen_at"].timestamp(), x["id"]))
                    found.append((rung, -100, 0, best["canonical_id"], ("old", best["canonical_id"])))
            for rung, key in ((1, KEYS[0]), (6, KEYS[3])):
                if r[key] is not None and not (rung == 6 and r["company_key"] == "unknown"):
                    found += [(rung, 0, 0, x["id"], ("old", x["id"])) for x in old if x[key] == r[key]]
            for rung, key in zip((0, 2, 4, 6), KEYS, strict=True):
                if r[key] is not None and not (rung == 6 and r["company_key"] == "unknown"):
                    found += [(rung, 0 if rung == 6 else -100, 1, x["arrival"], ("new", x["id"])) for x in before if x[key] == r[key] and not (rung == 6 and x["company_key"] == "unknown")]
            found += [(9, -scores[x["id"], r["id"]], 0, x["id"], ("old", x["id"])) for x in old if scores.get((x["id"], r["id"]), 0) >= 45]
            found += [(9, -scores[x["id"], r["id"]], 1, x["arrival"], ("new", x["id"])) for x in before if scores.get((x["id"], r["id"]), 0) >= 45]
            if found:
                rung, *_, (side, to) = min(found)
                how = {0: "applyUrlKey", 1: "applyUrlKey", 2: "sourceUrlKey", 4: "postingIdKey", 6: "duplicateCluster", 9: "similarity"}[rung]
                ends[r["id"]] = (to, None, how) if side == "old" else (*ends[to][:2], how)
            else:
                ends[r["id"]] = (None, r["id"], None)
        before.append(r)
    return ends


@pytest.mark.parametrize("seed", [1, 2])
def test_order_is_that_of_the_loop(spark, seed):
    rng = random.Random(seed)
    known, new = jobs(rng, 15, 1), jobs(rng, 60, 1000, hot=seed == 2)
    maps = [(i, rng.choice(known)[0], *(rng.choice([f"{p}{rng.randrange(60)}", None]) for p in "usp"), rng.choice([None, NOW]), rng.random() < 0.5, rng.randrange(3), NOW - dt.timedelta(days=rng.randrange(3))) for i in range(25)]
    settled = {new[k][0]: known[k][0] for k in (3, 9)}
    k, n = spark.createDataFrame(known, JOB), spark.createDataFrame(new, JOB).repartition(3)
    scores = {(r["known_id"], r["new_id"]): r["score"] for side in (k, n) for r in matching.score_pairs(side, n).collect()}
    got = polls.resolve(n, spark.createDataFrame(list(settled.items()), "id long, canonical_id long"), spark.createDataFrame(maps, MAP), k)
    want = loop(new, settled, maps, known, scores)
    assert {r["id"]: (r["canonical_id"], r["created_by"], r["how"]) for r in got.collect()} == want
    assert any(c is None and b != i for i, (c, b, _) in want.items()) and any(c for c, *_ in want.values())


def test_a_long_chain_is_followed_to_its_end(spark):
    rows = [(i, i, "acme", "", f"t{i}", "", "", None, "", "", NOW, "", "", None, f"k{i // 2}", f"k{(i + 1) // 2}", None) for i in range(100)]
    none = spark.createDataFrame([], JOB)
    got = polls.resolve(spark.createDataFrame(rows, JOB), spark.createDataFrame([], "id long, canonical_id long"), spark.createDataFrame([], MAP), none)
    assert {r["created_by"] for r in got.collect()} == {0}


# --- the fold --------------------------------------------------------------------------------------------------------

ROW = "id long, rank long, title string, company string, location string, role_family string, region string, work_mode string, employment_type string, description string, apply_url string, salary_min long, salary_max long, posted_at timestamp, deadline timestamp"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def values(rng):
    pick = rng.choice
    return (pick(["A", "B", "C", " "]), pick(["X", "Unknown", "", "Y"]), pick(["Bonn", "UNKNOWN", "Graz"]), pick(["SWE", "Unknown", ""]), pick(["US", None, "CA"]), pick(["REMOTE", "UNKNOWN", None]), pick(["FULL", "UNKNOWN", None, "PART"]), pick(["", " "]) if rng.random() < 0.2 else rng.choice("abcdefgh") * rng.randint(1, 60),
            pick(["", "u1 ", "u2", "u3"]), pick([None, 1, 2]), pick([None, 3]), NOW - dt.timedelta(days=rng.randrange(9)), pick([None, NOW, NOW + dt.timedelta(days=1)]))


def folded(now, posts):
    """posts: (arrival, row), one after the other."""
    c, top, n = dict(now), now["rank"], 0
    for _, x in sorted(posts, key=lambda p: p[0]):
        p = x["rank"] >= top
        for name, unknown in (("title", ""), ("company", "unknown"), ("location", "unknown"), ("role_family", "unknown")):
            good = lambda v, u=unknown: v.strip() != "" and v.strip().lower() != u
            if (p and good(x[name])) or (not good(c[name]) and (good(x[name]) or (p and x[name].strip()))):
                c[name] = x[name]
        c["region"] = (x["region"] or c["region"]) if p else (c["region"] or x["region"])
        for name in ("work_mode", "employment_type"):
            good = lambda v: v not in (None, "UNKNOWN")
            if (p and good(x[name])) or (not good(c[name]) and (good(x[name]) or (p and x[name] is not None) or c[name] is None)):
                c[name] = x[name]
        a, b = len(c["description"].strip()), len(x["description"].strip())
        if (p and b > 0 and b >= a * 6 // 10) or (a == 0 and b > 0):
            c["description"] = x["description"]
        a, b = c["apply_url"].strip(), x["apply_url"].strip()
        c["apply_url"] = b if not a or (b and p) else a
        if (x["salary_min"] is not None or x["salary_max"] is not None) and (p or (c["salary_min"] is None and c["salary_max"] is None)):
            c["salary_min"], c["salary_max"] = x["salary_min"], x["salary_max"]
        c["posted_at"] = min(c["posted_at"], x["posted_at"])
        c["deadline"] = min((d for d in (c["deadline"], x["deadline"]) if d), default=None)
        top, n = max(top, x["rank"]), n + 1
    c["rank"] = top
    return c | {"n_merged": n}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_the_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(polls, "CHUNK", (4096, 5, 2)[seed])
    rng = random.Random(seed)
    known = [(i, rng.randrange(4), *values(rng)) for i in range(1, 41)]
    posts = [(i, a, rng.randrange(5), *values(rng)) for a, i in enumerate(rng.choices([*range(1, 30), *[7] * 30], k=400))]
    p = spark.createDataFrame([(i, a, a, *rest) for i, a, *rest in posts], "target long, arrival long, " + ROW).repartition(3)
    got = {r["id"]: {k: r[k] for k in [*NAMES, "n_merged"]} for r in polls.fold(p, spark.createDataFrame(known, ROW)).collect()}
    for k in known:
        now = dict(zip(NAMES, k, strict=True))
        want = folded(now, [(a, dict(zip(NAMES, (i, *rest), strict=True))) for i, a, *rest in posts if i == k[0]])
        want["apply_url"] = want["apply_url"].strip()
        if not want["description"].strip():
            want["description"] = got[k[0]]["description"] if not got[k[0]]["description"].strip() else want["description"]
        assert got[k[0]] == want
