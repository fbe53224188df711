"""Personal data: base patterns, and terms that disclose a protected entity.

The base kinds are found by regular expressions.  Every distinct value found is a protected
entity.  A term is read as revealing an entity by the share of the entity's information it
carries: pointwise mutual information of term and entity over documents, divided by the
entity's own information content.  A term that shares at least ``SUPPORT`` different texts with
an entity, on whatever lines, and carries at least ``GENERALISE`` of its information is
generalised, from ``REMOVE`` on it is removed: everywhere, also where the entity is not.
Everything is DataFrame operations.  Texts are known by 128 bits of their content; pairs are
made only of terms rare enough, and entities frequent enough, to pass both thresholds.

A null text is empty: no spans.  Repeated rows and copies give the same result each; copies
of a text count as documents, but once as support.  Extra columns pass through or are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, packed, unpacked, whole_text, words, written

# The start conditions and possessive repeats keep the work linear in the text and do not
# change what is found: a match never starts inside a run whose start was tried.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
# A text without these cannot hold the kind.
SIGNS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "+"}
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"
# Stands for an entity while the terms of its text are read; words that touch it are no terms.
HOLE = "\ue000"

SUPPORT = 3
GENERALISE = 0.6
REMOVE = 0.8

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _total(lengths: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, 1, n), F.lit(0), lambda a, x: a + x)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the check-digit test."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 0, doubled).otherwise(digit)

    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # At most three digits after leading zeros, so that the cast cannot overflow.
        plain = F.transform(F.split(value, "\\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(
            plain,
            lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255)
            .otherwise(False),
        )
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _sign(kind: str, text: str) -> Column:
    if kind in ("email", "phone"):
        return F.col(text).contains(SIGNS[kind])
    return F.col(text).rlike(SIGNS[kind])


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add the array ``base``: kind number, start, end (code points) and value."""
    none = F.array().cast("array<string>")
    found = df.withColumns(
        {
            f"m_{k}": F.when(
                _sign(k, text), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
            ).otherwise(none)
            for k, p in PATTERNS.items()
        }
    )
    cut = found.withColumns(
        {
            f"p_{k}": F.when(
                F.size(f"m_{k}") > 0,
                F.transform(F.split(F.col(text), p, -1), lambda x: F.length(x)),
            )
            for k, p in PATTERNS.items()
        }
    ).withColumns(
        {f"l_{k}": F.transform(f"m_{k}", lambda x: F.length(x)) for k in PATTERNS}
    )

    def spans(number: int, kind: str) -> Column:
        pieces, lengths, values = F.col(f"p_{kind}"), F.col(f"l_{kind}"), F.col(f"m_{kind}")

        def span(value: Column, i: Column) -> Column:
            start = _total(pieces, i + 1) + _total(lengths, i)
            return F.struct(
                F.lit(number).alias("kind"),
                start.alias("start"),
                (start + F.get(lengths, i)).alias("end"),
                value.alias("value"),
            )

        # The place counts all matches; the test drops failing ones afterwards.
        return F.when(
            F.size(values) > 0,
            F.filter(F.transform(values, span), lambda s: _valid(kind, s.getField("value"))),
        ).otherwise(F.array().cast(SPAN))

    parts = [spans(n, k) for n, k in enumerate(PATTERNS)]
    helpers = [f"{a}_{k}" for a in "mpl" for k in PATTERNS]
    return cut.withColumn("base", F.concat(*parts)).drop(*helpers)


def _entity(span: Column) -> Column:
    """One value per protected entity: case and punctuation do not matter."""
    kind, value = span.getField("kind"), span.getField("value")
    plain = F.when(kind >= 2, _digits(value)).otherwise(F.lower(value))
    return F.concat_ws(":", kind.cast("string"), plain)


def _term(word: Column) -> Column:
    return F.lower(F.trim(word, F.lit(EDGES)))


def _is_term(term: Column) -> Column:
    return F.length(term) >= 3


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _information(n_all: Column, n: Column) -> Column:
    return F.log2(n_all / n)


def _term_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(_term(w))))


def documents_of_terms(texts: DataFrame) -> DataFrame:
    """Number of documents that hold each term, known by its hash."""
    hashes = texts.select(F.explode(_term_hashes(F.col("t"))).alias("term_hash"))
    return hashes.groupBy("term_hash").agg(F.count("*").alias("n_term"))


def disclosures(found: DataFrame, occurring: DataFrame) -> DataFrame:
    """Terms and the largest share of an entity's information each of them carries.

    ``found`` has every document (``key``, ``base`` and, if there are spans, ``t``),
    ``occurring`` the documents of each term.
    """
    texts = (
        found.where(F.size("base") > 0)
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("t").alias("t"))
    )
    holding = texts.select(
        "key", "copies", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")
    )
    entities = (
        holding.groupBy("entity")
        .agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_entity"))
        .where(F.col("n_texts") >= SUPPORT)
    )
    protected = (
        holding.join(entities, "entity")
        .groupBy("key")
        .agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    )
    holes = F.transform("base", lambda s: s.withField("value", F.lit(HOLE)))
    terms = (
        texts.join(protected, "key")
        .select(
            "key",
            "copies",
            "entities",
            F.explode(
                F.array_distinct(F.transform(words(_replaced(F.col("t"), holes)), _term))
            ).alias("term"),
        )
        .where(_is_term(F.col("term")) & ~F.col("term").contains(HOLE))
    )
    total = found.agg(F.count("*").alias("n_all"))
    known = (
        terms.withColumn("term_hash", F.xxhash64("term"))
        .join(occurring.where(F.col("n_term") >= SUPPORT), "term_hash")
        .join(F.broadcast(total))  # one row
    )
    # No pair carries more than the term's own information.
    own = _information(F.col("n_all"), F.col("n_term"))
    enough = F.filter(
        "entities",
        lambda e: own
        >= GENERALISE * _information(F.col("n_all"), e.getField("n_entity")) - 1e-9,
    )
    pairs = known.select(
        "key", "copies", "term", "n_term", "n_all", F.explode(enough).alias("e")
    ).select("key", "copies", "term", "n_term", "n_all", "e.entity", "e.n_entity")
    joint = (
        pairs.groupBy("term", "entity")
        .agg(
            F.count("*").alias("support"),
            F.sum("copies").alias("n_joint"),
            *[F.first(c).alias(c) for c in ("n_term", "n_entity", "n_all")],
        )
        .where(F.col("support") >= SUPPORT)
    )
    both = F.least("n_joint", "n_term", "n_entity").cast("double")
    held = _information(F.col("n_all"), F.col("n_entity"))
    pmi = F.log2(both * F.col("n_all") / (F.col("n_term") * F.col("n_entity")))
    share = F.when(held > 0, pmi / held).otherwise(F.lit(0.0))
    return (
        joint.withColumn("share", share)
        .where(F.col("share") >= GENERALISE)
        .groupBy("term")
        .agg(F.max("share").alias("share"))
    )


def term_spans(texts: DataFrame, strong: DataFrame) -> DataFrame:
    """``key``, ``t``, ``base`` and ``terms`` of texts that hold strong terms.

    ``texts`` has ``key`` and ``t``; ``strong`` names the terms of each: key, term, share.
    Words are looked up among the terms of their own line, so that only spans are exchanged.
    """
    named = strong.groupBy("key").agg(
        F.collect_list("term").alias("names"),
        F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone"),
    )
    hit = texts.join(named, "key").dropDuplicates(["key"])
    lines = hit.select(
        "key", "names", "gone", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line")
    ).withColumn("width", F.length("line") + 1)
    in_text = Window.partitionBy("key").orderBy("line_no")
    placed = (
        lines.withColumn(
            "line_start", (F.sum("width").over(in_text) - F.col("width")).cast("int")
        )
        .withColumn("names", F.array_intersect(F.transform(words(F.col("line")), _term), "names"))
        .where(F.size("names") > 0)
        .withColumn("gone", F.array_intersect("names", "gone"))
    )
    cut = placed.select(
        "key",
        "line_no",
        "line_start",
        "names",
        "gone",
        F.posexplode(
            F.arrays_zip(
                F.transform(F.split("line", WORD, -1), lambda x: F.length(x)).alias("gap"),
                words(F.col("line")).alias("word"),
            )
        ).alias("place", "piece"),
    )
    in_line = Window.partitionBy("key", "line_no").orderBy("place")
    length = F.coalesce(F.length("piece.word"), F.lit(0))
    ends = F.sum(F.col("piece.gap") + length).over(in_line)
    word = F.col("piece.word")
    left = F.length(word) - F.length(F.ltrim(word, F.lit(EDGES)))
    start = (F.col("line_start") + ends - length + left).cast("int")
    spots = cut.select("key", "names", "gone", _term(word).alias("term"), start.alias("start"))
    spans = (
        spots.where(F.array_contains("names", F.col("term")))
        .groupBy("key")
        .agg(
            F.collect_list(
                F.struct(
                    F.lit(len(PATTERNS)).alias("kind"),
                    "start",
                    (F.col("start") + F.length("term")).alias("end"),
                    F.when(F.array_contains("gone", F.col("term")), "")
                    .otherwise("<TERM>")
                    .alias("value"),
                )
            ).alias("spans")
        )
    )
    outside = F.filter(
        "spans",
        lambda s: F.forall(
            "base",
            lambda b: (b.getField("end") <= s.getField("start"))
            | (b.getField("start") >= s.getField("end")),
        ),
    )
    both = hit.select("key", "t").join(spans, "key")
    return base_spans(both, "t").select("key", "t", "base", outside.alias("terms"))


def _kinds(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(
                ":",
                F.get(names, s.getField("kind")),
                s.getField("start").cast("string"),
                s.getField("end").cast("string"),
            ),
        ),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with spans replaced, left to right; ``value`` holds the replacement."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    by_start = F.sort_array(
        F.transform(
            spans,
            lambda s: F.struct(
                s.getField("start").alias("start"),
                (-s.getField("end")).alias("minus_end"),
                s.getField("value").alias("value"),
            ),
        )
    )

    def step(a: Column, s: Column) -> Column:
        at, begin = a.getField("at"), s.getField("start")
        return F.when(
            begin >= at,
            F.struct(
                F.concat(
                    a.getField("out"), F.substring(text, at + 1, begin - at), s.getField("value")
                ).alias("out"),
                (-s.getField("minus_end")).alias("at"),
            ),
        ).otherwise(a)

    return F.aggregate(
        by_start,
        start,
        step,
        lambda a: F.concat(
            a.getField("out"), F.substring(text, a.getField("at") + 1, F.length(text))
        ),
    )


def _masked(text: str, *terms: str) -> Column:
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in PATTERNS])
    masks = F.transform(
        "base", lambda s: s.withField("value", F.get(names, s.getField("kind")))
    )
    return _replaced(F.col(text), F.concat(masks, *terms))


def analysed(docs: DataFrame, made=lambda text: text) -> DataFrame:
    """``row`` (without text), ``base``, ``terms`` and ``made`` of the sanitised text, null if
    that is the text itself.

    Base spans, strong terms and the texts these occur in are written to the shared folder
    once; only texts with an entity are kept there.
    """
    light = [c for c in docs.columns if c.lower() != "text"]
    texts = docs.select(whole_text().alias("t")).withColumn("key", _key(F.col("t")))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in light]).alias("row"),
        whole_text().alias("t"),
    ).withColumn("key", _key(F.col("t")))
    found = written(
        base_spans(keyed, "t").select(
            "row",
            "key",
            "base",
            F.when(F.size("base") > 0, F.col("t")).alias("t"),
        ),
        "pii-spans",
    )
    strong = written(
        disclosures(found, documents_of_terms(texts)).withColumn(
            "term_hash", F.xxhash64("term")
        ),
        "pii-terms",
    )
    hits = written(
        texts.select("key", F.explode(_term_hashes(F.col("t"))).alias("term_hash"))
        .join(strong, "term_hash")
        .select("key", "term", "share")
        .distinct(),
        "pii-hits",
    )
    named = term_spans(texts, hits).select(
        F.col("key").alias("k"), "terms", made(_masked("t", "terms")).alias("cleaned")
    )
    masked = found.select(
        "row", "key", "base", F.when(F.col("t").isNotNull(), made(_masked("t"))).alias("masked")
    )
    return masked.join(named, F.col("key") == F.col("k"), "left").select(
        "row",
        "key",
        "base",
        F.coalesce("terms", F.array().cast(SPAN)).alias("terms"),
        F.coalesce("cleaned", "masked").alias("clean"),
    )


def digest(docs: DataFrame) -> DataFrame:
    found = analysed(docs.select("doc_id", "text"), lambda text: F.sha2(text.cast("binary"), 256))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s.getField("kind") == number)).cast("long")

    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(n).alias(f"n_{k}") for n, k in enumerate(PATTERNS)],
        F.sha2(_kinds(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _kinds(F.concat("base", "terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
        F.col("clean").alias("sanitised_sha256"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with entities masked and disclosing terms generalised or removed."""
    spotted = analysed(docs.select(F.lit(1).alias("one"), "text")).where(F.col("clean").isNotNull())
    clean = spotted.groupBy(F.col("key").alias("k")).agg(F.first("clean").alias("clean"))
    rows = packed(docs).withColumn("key", _key(whole_text("row.text")))
    joined = rows.join(clean, F.col("key") == F.col("k"), "left")
    text = F.coalesce("clean", F.col("row.text"))
    return unpacked(
        joined.withColumn("row", F.col("row").withField("text", text)), docs.columns
    )
