"""The pipeline's stages, one by one, on a small table."""

import re

import corpus_pipeline
from sofralytics.llm import quality_cnn, sentencepiece
from sofralytics.llm.common import saved
from sofralytics.llm.queries import PIECES
from tests.llm.test_operators import base_spans


def test_stages(spark, docs, small):
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = saved(stage(spark, now, small), name)
        steps[name] = now
        if name != "encoding":
            assert now.columns == docs.columns
    rows = {k: v.collect() for k, v in steps.items()}
    before = {r["doc_id"]: r for r in docs.collect()}

    good = {r["doc_id"] for r in rows["quality"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert sum(k in good for k, q in labels.items() if q == 1) >= 0.95 * sum(q == 1 for q in labels.values())
    assert sum(k in good for k, q in labels.items() if q == 0) <= 0.5 * sum(q == 0 for q in labels.values())

    assert sorted(r["doc_id"] for r in rows["near_duplicates"]) == brute_force_firsts({k: before[k]["text"] for k in good})

    for r in rows["pii"]:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        plain = re.split(r"<(?:EMAIL|IP|CARD|PHONE|IBAN|SSN)>", r["text"])
        assert all(p in before[r["doc_id"]]["text"] for p in plain)

    texts = {r["doc_id"]: r["text"] for r in rows["pii"]}
    assert rows["mixing"] and all(r["text"] == texts[r["doc_id"]] for r in rows["mixing"])
    assert len(rows["encoding"]) == len(rows["mixing"])
    vocabulary = sentencepiece.Vocabulary.load(PIECES)
    for r in rows["encoding"][:50]:
        assert r["round_trip"] and sentencepiece.decoded(vocabulary.bytes, r["ids"]).decode() == texts[r["doc_id"]]


def test_odd_rows_pass_through(spark, odd, small):
    now = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        now = saved(stage(spark, now, small), "odd")
    assert now.where("NOT round_trip").count() == 0
    empty = odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = saved(stage(spark, empty, small), "none")
    assert empty.count() == 0


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, odd, small):
    kept = corpus_pipeline.near_duplicates(spark, odd, small).collect()
    assert sum(r["doc_id"] == 1 for r in kept) == 1 and quality_cnn.THRESHOLD == 0.3


def brute_force_firsts(texts):
    """The smallest id of each set of documents linked by five-word-shingle Jaccard of 0.8 or more."""

    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()

    held = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in held}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in held.items():
        for b, y in held.items():
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted({find(k) for k in held})


def test_near_duplicate_stage_equals_brute_force_jaccard(spark, docs, small):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    word = lambda i: f"w{i}"
    base = [word(i) for i in range(100)]
    texts |= {10_000: " ".join(base)}
    for k, cuts in enumerate(((50,), (20, 70), (10, 50, 90), (5, 30, 60, 90)), 1):  # 5, 10, 15 and 20 shingles of 96 change
        texts[10_000 + k] = " ".join(f"x{k}" if i in cuts else w for i, w in enumerate(base))
    texts |= {20_000 + k: " ".join(map(word, range(500 + 3 * k, 560 + 3 * k))) for k in range(12)}  # a chain
    rows = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in texts.items()], docs.schema)
    kept = corpus_pipeline.near_duplicates(spark, rows, small)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_force_firsts(texts)
    assert 10_001 not in brute_force_firsts(texts)


def test_near_duplicate_stage_links_by_simhash(spark, docs):
    """SimHash finds copies with few words changed, and what it finds is tried whether or not an index entry is shared."""
    from sofralytics.llm import near_copies, simhash

    base = [f"w{i}" for i in range(1000)]
    texts = {k: " ".join(f"x{k}" if i == 100 * k else w for i, w in enumerate(base)) for k in range(1, 6)} | {9: "other words in a row here"}
    rows = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in texts.items()], docs.schema)
    found = near_copies.prints(rows).select("doc_id", "fp", "mark").collect()
    marks = {r["doc_id"]: r["mark"] % 2**64 for r in found}
    assert marks == {k: simhash.fingerprint(t.encode(), 5) for k, t in texts.items()}
    ids = {r["fp"]: r["doc_id"] for r in found}
    pairs = {frozenset((ids[r["a"]], ids[r["b"]])) for r in near_copies.marked(near_copies.prints(rows)).collect()}
    close = {frozenset((a, b)) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= simhash.MAX_BITS}
    assert pairs and pairs <= close and set().union(*pairs) == set().union(*close)


def test_near_duplicate_order_changes_no_result(spark, docs, small, monkeypatch):
    from sofralytics.llm import near_copies

    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    kept = corpus_pipeline.near_duplicates(spark, docs, small)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_force_firsts({r["doc_id"]: r["text"] for r in docs.collect()})


def test_close_pairs_of_a_task_connect_what_all_pairs_do():
    import numpy as np

    from sofralytics.llm import near_copies

    random = np.random.default_rng(4)
    sizes = [1, 2, 40, 90]
    group = np.repeat(np.arange(len(sizes)), sizes)
    held = []
    for g, size in enumerate(sizes):
        base = random.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(size):
            changed = base.copy()
            changed[random.integers(0, 60, random.integers(0, 16))] = random.integers(0, 2**63)
            held.append(np.unique(changed))
            base = changed if random.random() < 0.5 else base  # similar sets drift apart
    n = np.array([len(h) for h in held], np.int32)
    sketch = np.frombuffer(b"".join(map(near_copies.parity, held)), np.uint64).reshape(len(held), -1)
    fp = np.arange(len(held))
    root = np.where(random.random(len(held)) < 0.3, group * 1000, fp + 10**6)
    part = np.where(group == 3, fp % 2, -1)

    def joined(forest):
        pairs = [(int(a), int(b)) for x, y in near_copies.met(group, part, fp, root, n, sketch, forest) for a, b in zip(x, y)]
        low = {(int(g), int(r)): (int(g), int(r)) for g, r in zip(group, root)}

        def find(k):
            while low[k] != k:
                k = low[k]
            return k

        for a, b in pairs:
            x, y = sorted((find((int(group[a]), int(root[a]))), find((int(group[b]), int(root[b])))))
            low[y] = x
        return pairs, [find(k) for k in low]

    every, forest = joined(False), joined(True)
    assert every[1] == forest[1] and set(forest[0]) <= set(every[0])
    assert len(forest[0]) < min(len(held), len(every[0]))
