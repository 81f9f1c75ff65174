"""Alignment against a plain walk with the tokenizers' own libraries; the galloping search against a sorted look-up."""

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from sofralytics.llm import alignment
from sofralytics.llm.queries import BYTE_LEVEL, PIECES, QUERIES

ODD = [
    None, "", " ", "   ", "\n\n a", "a", "word", "<|endoftext|> and </s> <unk> <s>", "Ünïcödé 漢字 \U0001f600 👩‍👩‍👧", "▁ is a piece's blank", "tab\tand\r\nline", " 　x",
    "1234567890" * 50, "abc" * 3000, "don't we'll I'm", "\x00nul", "é", "ا ب ت", "<0x41>", " leading and trailing ",
]


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def spelt(text):
    """Ids and bytes of both vocabularies' tokens; none where the bytes are not those of the text."""
    if not text:
        return [], []
    a, b = libraries()
    letters = alignment.byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], []
    return list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))


def spans(tokens):
    at, out = 0, []
    for i, held in tokens:
        out.append((i, at, at + len(held)))
        at += len(held)
    return out


def brute(texts):
    """Results of each text, corpus counts over all."""
    linked, found, corpus = [], [], Counter()
    for text in texts:
        a, b = map(spans, spelt(text))
        common = {e for _, _, e in a} & {e for _, _, e in b}
        groups, start = [], 0
        for end in sorted(common):
            groups.append(",".join(str(i) for i, s, e in a if start <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in b if start <= s and e <= end))
            start = end
        links, first = Counter(), 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            for j, x, y in b[first:]:
                if x >= e:
                    break
                links[i, j] += 1
        corpus += links
        linked.append(links)
        found.append([len(a), len(b), len(groups), sum(links.values()), ";".join(groups)])
    best = defaultdict(int)
    for (_, j), n in corpus.items():
        best[j] = max(best[j], n)
    weigh = lambda links: [sum(n for p, n in links.items() if corpus[p] == best[p[1]]), sum(n * corpus[p] for p, n in links.items())]
    return [[*f[:4], *weigh(links), f[4]] for f, links in zip(found, linked)]


def rows_of(frame):
    return [[r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], bytes(r["groups"]).decode()] for r in frame.orderBy("doc_id").collect()]


@pytest.mark.parametrize("listed", [0, 7, alignment.LISTED])
def test_odd_texts_equal_a_walk(spark, listed):
    texts = [*ODD, *ODD[3:9], "the same text again", "the same text again"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(frame, BYTE_LEVEL, PIECES, listed=listed)) == brute(texts)


def test_query_equals_a_walk(spark, small, docs):
    every = {r["doc_id"]: r for r in QUERIES["op11_alignment"](spark, small).collect()}
    all_rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = {r["doc_id"]: w for r, w in zip(all_rows, brute([r["text"] for r in all_rows]))}
    assert every.keys() == want.keys()
    for doc_id, (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) in want.items():
        r = every[doc_id]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_gallop_equals_a_sorted_look_up():
    random = np.random.default_rng(2)
    for n in (1, 2, 7, 100, 5000):
        longer = np.unique(random.integers(1, 10 * n + 2, n * 3))
        driver = np.sort(random.integers(0, longer[-1] + 1, n))
        at = random.integers(0, len(longer), n)
        got = alignment.gallop(driver, longer, at, np.zeros(n, np.int64), np.full(n, len(longer) - 1))
        assert np.array_equal(got, np.searchsorted(longer, driver))


def test_byte_level_ids_equal_the_library():
    library, own = libraries()[0], alignment.byte_level(BYTE_LEVEL)
    for text in [t for t in ODD if t]:
        assert own.encode([text])[0].tolist() == library.encode(" " + text, add_special_tokens=False).ids


def test_long_unbroken_text(spark):
    text = "abcdefgh" * 20_000
    r = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE_LEVEL, PIECES).first()
    assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]


def test_clashing_names_nulls_and_empty_table(spark, odd):
    clashing = odd.withColumn("pairs", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("_rest", F.lit("r"))
    found = alignment.align(clashing, BYTE_LEVEL, PIECES)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "score", "host", "_row", "_rest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = found.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(x) for x in (1, 1, 2, 3, None, 4, 5, -7))
    assert {(r["_row"], r["_rest"]) for r in got} == {(1, "r")}
    assert alignment.align(clashing.limit(0), BYTE_LEVEL, PIECES).collect() == []
