"""Decontamination against every window of every text, compared exactly."""

import random
import re
from collections import Counter

from auditframe.llm import decontaminate, queries


def words(text):
    return re.findall(r"[^\W]+", (text or "").lower())


def grams(ws, k=5):
    k = min(k, len(ws))
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def brute(texts, items):
    found = {}
    for row, text in enumerate(texts):
        ws = words(text)
        for item, t in items:
            own = words(t)
            if not own or not ws:
                continue
            n, target = min(len(own), len(ws)), grams(own)
            if n < min(5, len(own)):
                continue
            scores = [decontaminate.weighted_similarity(grams(ws[i : i + n], min(5, len(own))), target) for i in range(len(ws) - n + 1)]
            best = max(scores)
            if best >= 0.8 - 1e-12:
                found[row, item] = (scores.index(best), n, round(best, 9))
    return found


def test_all_windows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([3, 5, 9, 20, 20, 45])))) for i in range(25)]
    items += [(25, ""), (26, None), (None, "a b c d e f"), (27, items[4][1])]
    texts = [None, "", "w1", " ".join(text(4))]
    for n in range(120):
        own, item = text(rng.randrange(0, 80)), words(items[n % 25][1])
        if n % 3 == 0 and item:  # an edit in the middle or at an end
            item[rng.choice([0, -1, len(item) // 2])] = "other"
        if n % 7 == 0:
            item = item[: int(len(item) * 0.9)]
        at = rng.randrange(0, len(own) + 1)
        texts.append(" ".join(own[:at] + item + own[at:]).upper().replace(" ", ", " if n % 2 else "\n"))
    texts.append("w7 " * 30000 + items[3][1])
    df = spark.createDataFrame([(n, t, 1, "x") for n, t in enumerate(texts)], "doc_id long, text string, matches int, c0 string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(df, bench, carry=["doc_id", "c0"])
    assert got.columns == ["doc_id", "c0", "matches"]
    rows = {(r.doc_id, m.item_id): (m.start, m.words, round(m.similarity, 9)) for r in got.collect() for m in r.matches}
    assert rows == brute(texts, [i for i in items if i[0] is not None and i[1] is not None])
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in rows}
    assert decontaminate.find_matches(df.limit(0), bench).collect() == []
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(texts)


def test_passes_agree(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "k l m n o p q"), (3, "z")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g"), (8, "k l m n o p q"), (9, "b c d e f g h")], "item_id long, text string")
    one = sorted(map(str, decontaminate.find_matches(df, bench).select("doc_id", "matches.item_id").collect()))
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 1)
    many = decontaminate.find_matches(df, bench, carry=["doc_id"])
    got = sorted(str(r) for r in many.selectExpr("doc_id", "array_sort(matches.item_id) item_id").collect())
    assert got == one


def test_ids_of_any_type_and_repeated_rows(spark, monkeypatch):
    df = spark.createDataFrame([("x", "a b c d e f g h")] * 2 + [(None, "k l m n o p q"), ("y", None)], "doc_id string, text string")
    bench = spark.createDataFrame([("it/7", "a b c d e f g"), ("it/8", "k l m n o p q")], "item_id string, text string")
    for bound in (20_000, 1):
        monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", bound)
        rows = decontaminate.find_matches(df, bench).collect()
        assert sorted((str(r.doc_id), [m.item_id for m in r.matches]) for r in rows) == [("None", ["it/8"]), ("x", ["it/7"]), ("x", ["it/7"]), ("y", [])]
        assert [r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()] == ["y"]
    pairs = bench.selectExpr("named_struct('a', item_id) AS item_id", "text")
    assert decontaminate.find_matches(df, pairs).filter("size(matches) > 0").count() == 3


def test_query_finds_planted_passages(spark, sf_dir):
    texts = {r.doc_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_decontamination"](spark, sf_dir).collect()}
    assert whole and whole <= got
