"""Text normalisation over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv
from sofralytics.functions import text
from sofralytics.plans.registry import query, stripped, strings

TR_LOWER = "lower(translate({c}, 'İI', 'iı'))"
TOKENS = "regexp_extract_all(" + TR_LOWER.format(c="text") + ", '[\\p{L}\\p{N}_]+')"


@query("turkish_lower", sql=f"SELECT doc_id, md5({TR_LOWER.format(c='text')}) AS lower_md5 FROM documents")
def turkish_lower(t):
    return t.documents.select("doc_id", F.md5(text.turkish_lower(F.col("text"))).alias("lower_md5"))


@query(
    "tokens",
    sql=f"""SELECT doc_id, len(w) AS token_count, md5(array_to_string(w, ' ')) AS tokens_md5
            FROM (SELECT doc_id, {TOKENS} AS w FROM documents)""",
)
def tokens(t):
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("token_count"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query(
    "tokens_without_stopwords",
    sql=f"""SELECT doc_id, len(w) AS kept_count, md5(array_to_string(w, ' ')) AS kept_md5 FROM (SELECT doc_id,
            list_filter({TOKENS}, lambda x: NOT list_contains({strings(fv.TURKISH_STOPWORDS)}, x)) AS w FROM documents)""",
)
def tokens_without_stopwords(t):
    rows = t.documents.select("doc_id", text.without_stopwords(text.tokens(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("kept_count"), F.md5(F.array_join("w", " ")).alias("kept_md5"))


@query(
    "token_ngrams",
    sql=f"""SELECT doc_id, greatest(len(w) - 1, 0) AS bigrams, greatest(len(w) - 2, 0) AS trigrams,
            md5(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|')) AS bigram_md5
            FROM (SELECT doc_id, {TOKENS} AS w FROM documents)""",
)
def token_ngrams(t):
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w")).select(
        "doc_id", text.ngrams(F.col("w"), 2).alias("two"), text.ngrams(F.col("w"), 3).alias("three")
    )
    return rows.select(
        "doc_id", F.size("two").cast("long").alias("bigrams"), F.size("three").cast("long").alias("trigrams"),
        F.md5(F.array_join("two", "|")).alias("bigram_md5"),
    )


NORMALIZE = "trim(regexp_replace(" + TR_LOWER + ", '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("normalized_text", sql=f"SELECT doc_id, md5({NORMALIZE.format(c='text')}) AS normal_md5 FROM documents")
def normalized_text(t):
    return t.documents.select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal_md5"))


@query(
    "ascii_fold",
    sql=f"SELECT doc_id, md5(translate({NORMALIZE.format(c='text')}, 'çğıöşü', 'cgiosu')) AS folded_md5 FROM documents",
)
def ascii_fold(t):
    return t.documents.select("doc_id", F.md5(text.ascii_fold(text.normalize(F.col("text")))).alias("folded_md5"))


@query(
    "turkish_fold",
    sql=f"""SELECT doc_id, md5({stripped("lower(translate(text, 'çÇğĞıİöÖşŞüÜ', 'cCgGiIoOsSuU'))")}) AS folded_md5 FROM documents""",
)
def turkish_fold(t):
    return t.documents.select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded_md5"))


@query(
    "sentence_split",
    sql=f"""SELECT doc_id, len(s) AS sentence_count, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id,
           list_filter(list_transform(string_split_regex(text, '[.!?;]+'), lambda x: {stripped('x')}), lambda x: x <> '') AS s FROM documents)""",
)
def sentence_split(t):
    rows = t.documents.select("doc_id", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentence_count"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))
