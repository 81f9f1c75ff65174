"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Everything is column expressions on one row; no shuffle.  A null or empty text has no spans.  Repeated rows give
repeated results, other columns are not touched, an empty table gives an empty table.  Positions are code points,
0-based, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order of listing.  The first four are certain once validated.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4

# The proposals.  A run of characters that cannot match is skipped as one (look-behind, or the end of the
# match before), and repeats never give characters back, so long texts take linear time and no deep stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The length of an account number in each country of the IBAN registry.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?i:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTH.items()) + r")\b"
# Only the first four characters are taken, so that each place where an account may begin is looked at for itself.
IBAN_HEAD = rf"\b(?={IBAN})[A-Za-z]{{2}}[0-9]{{2}}"
IBAN_CHARS = 2 * max(IBAN_LENGTH)
LOCAL_PHONE = r"(?<![+0-9.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Words that make a neighbouring span likelier, and words that make it less likely.
CONTEXT = {
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|t[eé]l[eé]phone|tel[eé]fono|telefon)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|order|invoice|serial|sku)\b"
START = {"phone": 0.3, "iban": 0.9, "ssn": 0.3}  # a passed checksum outweighs a word against it
STEP, ACCEPT, NEAR = 0.4, 0.5, 40


# Each kind's proposals: column, kind, pattern, cheap necessary condition.
PROPOSED = (
    ("email", 0, EMAIL, lambda t: F.contains(t, F.lit("@"))),
    ("ip", 1, IP, lambda t: t.rlike("[0-9]\\.[0-9]")),
    ("card", 2, CARD, lambda t: t.rlike("[0-9][\\x20-]?[0-9]")),
    ("phone", 3, PHONE, lambda t: t.rlike("\\+[0-9]")),
    ("local", 3, LOCAL_PHONE, lambda t: t.rlike("[0-9]{3}")),
    ("iban", 4, IBAN_HEAD, lambda t: t.rlike("[A-Za-z]{2}[0-9]{2}")),
    ("ssn", 5, SSN, lambda t: t.rlike("-[0-9]{2}-")),
)
NO_MATCH = "array<struct<at:int,text:string>>"


def proposed(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_<kind>``: leftmost non-overlapping matches of each pattern as array<struct<at, text>>.

    The pieces between the matches give the positions: the i-th match starts after i+1 pieces and i matches.  The steps
    are separate projections, so that each pattern runs once over a text, and the pieces are cut only where it matched.
    """
    t, none = F.col(text), F.array().cast("array<string>")
    docs = docs.withColumns({f"_{name}": F.when(may(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none) for name, _, pattern, may in PROPOSED})
    return docs.withColumns({f"_{name}": F.when(F.size(f"_{name}") > 0, placed(t, pattern, F.col(f"_{name}"))).otherwise(F.array().cast(NO_MATCH)) for name, _, pattern, _ in PROPOSED})


def placed(text: Column, pattern: str, found: Column) -> Column:
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("text"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(NO_MATCH).alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.length(m["text"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + m["gap"]).alias("at"), m["text"].alias("text")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    size = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), size),
        F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.substring(number, i, F.lit(1)).cast("int"), (size - i) % 2 == 1),
    )
    return total % 10 == 0


def _luhn_digit(value: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(value > 4, value * 2 - 9).otherwise(value * 2)).otherwise(value)


def mod97(account: Column) -> Column:
    """The IBAN checksum: four leading characters moved to the end, letters as numbers, remainder 1."""
    compact = F.upper(F.regexp_replace(account, "\\x20", ""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    value = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: _append(acc, F.ascii(F.substring(turned, i, F.lit(1)))),
    )
    return value == 1


def _append(acc: Column, code: Column) -> Column:
    return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)


def small_part(part: Column) -> Column:
    """A part of an address is at most 255, whatever zeros lead it."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def accounts(text: Column, heads: Column) -> Column:
    """The heads' whole accounts, each as long as its country's are: array<struct<at, text>>."""
    whole = lambda m: F.regexp_extract(F.substring(text, m["at"] + 1, F.lit(IBAN_CHARS)), f"^{IBAN}", 0)
    return F.transform(heads, lambda m: F.struct(m["at"].alias("at"), whole(m).alias("text")))


def confirmed(kind: int, found: Column, valid) -> Column:
    """Spans of the matches that ``valid`` accepts."""
    return F.transform(
        F.filter(found, lambda m: valid(m["text"])),
        lambda m: F.struct(m["at"].alias("at"), F.lit(kind).alias("kind"), (m["at"] + F.length(m["text"])).alias("end"), F.lit(1.0).alias("score")),
    )


def weighed(kind: int, text: Column, found: Column, valid) -> Column:
    """Spans of valid matches whose score, raised or lowered by the words near them, reaches ``ACCEPT``."""
    name = KINDS[kind]

    def score(m: Column) -> Column:
        begin = F.greatest(m["at"] - NEAR, F.lit(0))
        near = F.substring(text, begin + 1, m["at"] + F.length(m["text"]) + NEAR - begin)
        plus = F.when(near.rlike(CONTEXT[name]), STEP).otherwise(0.0)
        minus = F.when(near.rlike(AGAINST), STEP).otherwise(0.0)
        return F.lit(START[name]) + plus - minus

    spans = F.transform(
        F.filter(found, lambda m: valid(m["text"])),
        lambda m: F.struct(m["at"].alias("at"), F.lit(kind).alias("kind"), (m["at"] + F.length(m["text"])).alias("end"), score(m).alias("score")),
    )
    return F.filter(spans, lambda s: s["score"] >= ACCEPT)


def base_spans() -> Column:
    """Validated spans of the first four kinds, ordered by start, then kind: array<struct<at, kind, end, score>>."""
    email = confirmed(0, F.col("_email"), lambda m: F.lit(True))
    ip = confirmed(1, F.col("_ip"), lambda m: F.forall(F.split(m, "\\."), small_part))
    card = confirmed(2, F.col("_card"), lambda m: F.length(digits(m)).between(12, 19) & luhn(digits(m)))
    phone = confirmed(3, F.col("_phone"), lambda m: F.length(digits(m)).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def added_spans(text: Column) -> Column:
    """What context and further checksums add: local phone numbers, bank accounts, social security numbers."""
    phone = weighed(3, text, F.col("_local"), lambda m: F.lit(True))
    iban = weighed(4, text, accounts(text, F.col("_iban")), mod97)
    ssn = weighed(5, text, F.col("_ssn"), lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"))
    return F.concat(phone, iban, ssn)


def all_spans(base: Column, added: Column) -> Column:
    """Base spans and those added ones that overlap no base span or are accounts, ordered by start, then kind.

    An account's checksum is as good as a card's, whose digits may be part of it; both are listed.
    """
    free = F.filter(added, lambda a: (a["kind"] == KINDS.index("iban")) | ~F.exists(base, lambda b: (a["at"] < b["end"]) & (b["at"] < a["end"])))
    return F.array_sort(F.concat(base, free))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["at"], s["end"])), ",")


def spanned(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_base`` and ``_spans``."""
    held = proposed(docs, text)
    held = held.withColumns({"_base": base_spans(), "_added": added_spans(F.col(text))})
    return held.withColumn("_spans", all_spans(F.col("_base"), F.col("_added")))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``text``, ``base`` and ``spans`` (arrays of start, kind, end, score)."""
    held = spanned(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return held.select("doc_id", "text", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans give one mark, the first's."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["at"] - acc["at"]), F.element_at(names, s["kind"] + 1)))
        fresh = s["at"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, mark).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, empty, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced and ``n_chars``, where present, brought up to date.

    A null text stays null.
    """
    own = {c: f"own{i}" for i, c in enumerate(docs.columns)}  # names that no step uses
    held = spanned(docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.coalesce("text", F.lit("")).alias("text")), "text")
    held = held.withColumn("_clean", redacted(F.col("text"), F.col("_spans")))
    changed = {"text": F.when(F.col(own["text"]).isNotNull(), F.col("_clean"))}
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size("_spans") > 0, F.length("_clean").cast(kind)).otherwise(F.col(own["n_chars"]))
    return held.select(*[changed.get(c, F.col(n)).alias(c) for c, n in own.items()])
