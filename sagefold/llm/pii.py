"""Personal data: known forms, and terms that disclose protected entities.

Known forms (``email``, ``ip``, ``card``, ``phone``) are regular expressions
with checks.  Each value found is a protected entity c.  A term t that stands
near it discloses it as far as their pointwise mutual information reaches the
entity's information content (as in C-sanitised documents):

    PMI(c; t) = log(n(c, t) N / (n(c) n(t))),   IC(c) = log(N / n(c))

with counts of documents over the whole corpus, in which copies count once: rows
with entities by classes of near copies, others by their texts.  A term counts as
evidence if it stands within REACH characters of the entity in ``support`` or more
such documents, in as many different passages.  A term whose PMI / IC reaches
``generalise`` is replaced by its class, from ``remove`` on it is removed, wherever
it stands.

Near copies have equal pairs of minima of hash functions over their shingles, and
half of all minima in common; chains of them are one class.

All of it runs as built-in expressions, in time linear in texts and spans.  Null
and empty texts have no spans.  Repeated rows each have theirs.  Spans that begin
together come in the order of KINDS.  Very long texts are texts like others.  Of
the input's columns only those asked for are read.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import blocks_of, bound, materialise, piece, prefixes, spans_of
from .jaccard import components

# Possessive quantifiers and the look-behind give the same leftmost matches in
# linear time: a match that begins inside a run of the class would have begun
# at the run's start, unless the match before ended there (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

KINDS = ["email", "ip", "card", "phone", "term"]
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
#: Characters on each side of an entity in which terms are near it.
REACH = 60
#: Characters beyond those in which documents with a common passage are alike too.
FAR = 100
#: The share of common words over which surroundings are one passage.
ALIKE = 0.5
#: Words of a shingle, and minima of a row's sketch, two of which are a key under which near copies meet.
SHINGLE, MINIMA = 3, 16
#: Rows up to which a table of terms is broadcast (some 10 MB).
MOST_BROADCAST = 200_000
_SPANS = "array<struct<s:int,k:int,e:int,kind:string,m:string>>"


def _as(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def known(text: Column) -> Column:
    """array<struct<s, k, e, kind, m>>: the known forms, by start and kind."""
    ips = F.filter(spans_of(text, IP, "."), lambda x: x["m"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}\z"))
    digits = lambda x: F.translate(x["m"], " -().+", "")
    cards = F.filter(spans_of(text, CARD), lambda x: F.length(digits(x)).between(14, 19) & F.call_function("luhn_check", digits(x)))
    phones = F.filter(spans_of(text, PHONE, "+"), lambda x: F.length(digits(x)).between(10, 15))
    return F.array_sort(F.concat(_as(spans_of(text, EMAIL, "@"), "email"), _as(ips, "ip"), _as(cards, "card"), _as(phones, "phone")))


def _terms(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def classes(spans: DataFrame) -> DataFrame:
    """(row, copy): the class of near copies of each row of ``spans`` (row, _text)."""
    words = F.filter(_terms(F.col("_text")), lambda w: w != "")
    texts = spans.groupBy(F.xxhash64("_text").alias("h")).agg(F.min("_text").alias("_text")).withColumn("w", words)
    n = F.greatest(F.lit(1), F.size("w") - SHINGLE + 1)
    of = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(SHINGLE)), " ")))
    sketch = F.array(*(F.array_min(F.transform("of", lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(MINIMA)))
    sketched = materialise(texts.withColumn("of", of).select("h", sketch.alias("sketch")), "sketches")
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("sketch")[k], F.col("sketch")[k + 1]) for k in range(0, MINIMA, 2)))
    keyed = sketched.select("h", "sketch", F.explode(keys).alias("key"))
    centre = keyed.groupBy("key").agg(F.min(F.struct("h", "sketch")).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "m")
    same = F.aggregate(F.zip_with("sketch", "m.sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = keyed.join(centre, "key").filter((F.col("h") != F.col("m.h")) & (same * 2 >= MINIMA))
    root = components(near.select(F.col("h").alias("a"), F.col("m.h").alias("b")))
    return spans.select("row", F.xxhash64("_text").alias("node")).join(root, "node", "left").select("row", F.coalesce("root", "node").alias("copy"))


def contexts(text: Column, spans: Column) -> Column:
    """array<struct<c, before, after>>: each entity and what stands REACH and FAR characters around it."""
    entity = lambda x: F.sha2(F.concat_ws(":", x["kind"], F.lower(x["m"])), 256)

    def around(b: Column) -> Column:
        def one(x: Column) -> Column:
            left, right = F.greatest(F.lit(0), x["s"] - REACH - FAR), F.least(b["n"], x["e"] + REACH + FAR)
            return F.struct(entity(x).alias("c"), piece(b["blocks"], left, x["s"]).alias("before"), piece(b["blocks"], x["e"], right).alias("after"))

        return F.transform(b["spans"], one)

    return bound(F.struct(spans.alias("spans"), blocks_of(text).alias("blocks"), F.length(text).alias("n")), around)


def _shingles(words: Column) -> Column:
    """Hashes of the runs of SHINGLE words; of all words if they are fewer."""
    n = F.greatest(F.lit(1), F.size(words) - SHINGLE + 1)
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")))).otherwise(F.array().cast("array<bigint>"))


def passages(mentions: DataFrame) -> DataFrame:
    """(node, root): mentions that stand in a passage with others, and that passage.

    ``mentions``: (m, c, before, after), m once.  Two mentions of an entity stand in
    one passage if more than ALIKE of the words around both are common ones; chains
    of such pairs are one.  Each mention is held against all that are the first to
    hold one of its words or shingles, so that pairs grow with the mentions.
    """
    sides = [F.filter(_terms(F.col(x)), lambda w: w != "") for x in ("before", "after")]
    words = F.array_distinct(F.transform(F.concat(*sides), lambda w: F.hash(w)))
    of = materialise(mentions.select("m", "c", words.alias("w"), F.concat(*map(_shingles, sides)).alias("shingles")), "surroundings")
    keyed = of.select("c", "m", F.explode(F.array_distinct(F.concat("shingles", F.col("w").cast("array<bigint>")))).alias("key"))
    first = keyed.groupBy("c", "key").agg(F.min("m").alias("o"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("c", "key", "o")
    pairs = materialise(keyed.join(first, ["c", "key"]).filter("m <> o").select("m", "o").distinct(), "pairs")
    both = pairs.join(of.select("m", "w"), "m").join(of.select(F.col("m").alias("o"), F.col("w").alias("w_o")), "o")
    alike = 2 * F.size(F.array_intersect("w", "w_o")) > ALIKE * (F.size("w") + F.size("w_o"))
    return components(both.filter(alike).select(F.col("m").alias("a"), F.col("o").alias("b")))


def evidence(found: DataFrame, support: int) -> DataFrame:
    """(c, t, n_ct): terms near entities in enough documents.

    ``found``: (row, copy, _text, base); ``copy`` is the class of near copies.
    Every whole term within REACH characters of an entity counts, and n_ct is the
    number of all documents in which it does.  Documents that share a passage are no
    copies of each other, but what stands in that passage is evidence once: a pair
    needs ``support`` documents and as many passages, where a mention of its own is
    one.  Only what stands around entities is multiplied by their number, not the text.
    """
    near = found.filter(F.size("base") > 0).select("copy", F.explode(contexts(F.col("_text"), F.col("base"))).alias("x")).select("copy", "x.*")
    many = near.groupBy("c").agg(F.count_distinct("copy").alias("n")).filter(F.col("n") >= support)
    near = near.join(many.select("c"), "c").withColumn("m", F.xxhash64("c", "before", "after")).dropDuplicates(["m", "copy"])
    near = materialise(near, "mentions")
    root = passages(near.dropDuplicates(["m"]))
    # a blank stands for the text's ends, one more character tells whether a term is whole
    sides = F.array(_terms(F.right(F.concat(F.lit(" "), "before"), F.lit(REACH + 1))), _terms(F.left(F.concat("after", F.lit(" ")), F.lit(REACH + 1))))
    whole = F.flatten(F.transform(sides, lambda w: F.slice(w, F.lit(2), F.greatest(F.lit(0), F.size(w) - 2))))
    placed = near.select("c", "copy", "m", F.explode(F.array_distinct(whole)).alias("t")).join(root, F.col("m") == F.col("node"), "left")
    by = placed.groupBy("c", "t").agg(F.count_distinct("copy").alias("n_ct"), F.count_distinct(F.coalesce("root", "m")).alias("passages"))
    return by.filter((F.col("n_ct") >= support) & (F.col("passages") >= support)).select("c", "t", "n_ct")


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast a stored table where its checked size allows it."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def scan(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", support: int = 2, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """(keep..., base, spans, _text): ``base`` the known forms, ``spans`` disclosing terms besides, with kind ``term`` and the action in ``m``.

    ``keep`` is the id alone unless given; ``_text`` is the text, null as empty.
    """
    keep = keep or [id_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(*(F.col(f"`{c}`") for c in keep), text.alias("_text")).withColumn("row", F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col("_text")))
    found = source.withColumn("base", known(F.col("_text")))
    spans = materialise(found.filter(F.size("base") > 0).select("row", "_text", "base").distinct(), "entities")
    terms, where = disclosing(spans, found.select("row", "_text"), support, generalise, remove)
    if terms is None:
        return found.select(*keep, "base", F.col("base").alias("spans"), "_text")
    by_row = where.join(_sized(terms), "t").groupBy("row").agg(F.collect_set(F.struct("t", "action")).alias("terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("terms", lambda x: x["t"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    actions = F.map_from_entries("terms")
    more = F.transform(spans_of(F.col("_text"), pattern), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index("term")).alias("k"), x["e"].alias("e"), F.lit("term").alias("kind"), F.coalesce(F.try_element_at(actions, F.lower(x["m"])), F.lit("generalise")).alias("m")))
    by_row = materialise(by_row, "rows")
    # only texts that may hold a term travel to their terms: a filter of bounded size tells the others
    blocks = bloom.block_count(by_row.count())
    some, others = bloom.split(source, F.col("row"), bloom.build(by_row, F.col("row"), blocks), blocks)
    met = some.join(by_row.hint("merge"), "row", "left").withColumn("base", known(F.col("_text"))).withColumn("more", F.when(F.col("terms").isNotNull(), more).otherwise(F.array().cast(_SPANS)))
    plain = others.withColumn("base", known(F.col("_text")))
    return met.select(*keep, "base", F.array_sort(F.concat("base", "more")).alias("spans"), "_text").unionByName(plain.select(*keep, "base", F.col("base").alias("spans"), "_text"))


def disclosing(spans: DataFrame, rows: DataFrame, support: int, generalise: float, remove: float) -> tuple[DataFrame | None, DataFrame | None]:
    """((t, action) of the terms over the thresholds, (row, t) where they stand); None without any.

    ``spans``: (row, _text, base) of the rows with entities; ``rows``: (row, _text) of all.

    Without evidence the corpus need not be read again: there is nothing to count.
    """
    classed = materialise(spans.join(classes(spans), "row"), "classed")
    pairs = materialise(evidence(classed, support), "pairs")
    if pairs.isEmpty():
        return None, None
    # texts by their class where they have one
    copies = materialise(classed.select(F.xxhash64("_text").alias("h"), "copy").distinct(), "copies")
    n = rows.select(F.xxhash64("_text").alias("h")).distinct().count() - copies.count() + copies.select("copy").distinct().count()
    entities = classed.select("copy", F.explode("base").alias("x")).select("copy", F.sha2(F.concat_ws(":", "x.kind", F.lower("x.m")), 256).alias("c")).distinct()
    n_c = entities.groupBy("c").agg(F.count(F.lit(1)).alias("n_c"))
    content = F.log(F.lit(float(n)) / F.col("n_c"))
    shared = F.least("n_ct", "n_t", "n_c").cast("double")
    ratio = F.when(content > 0, F.log(shared * F.lit(float(n)) / (F.col("n_c") * F.col("n_t"))) / content).otherwise(0.0)
    # a term is in as many documents at least as have entities and it: the ratio only falls with the others, so what is below is not counted in them
    least = classed.select("copy", F.explode(F.array_distinct(_terms(F.col("_text")))).alias("t")).distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    pairs = materialise(pairs.join(n_c, "c").join(least, "t").filter(ratio >= generalise - 1e-9).select("c", "t", "n_ct", "n_c"), "possible")
    if pairs.isEmpty():
        return None, None
    words = rows.select("row", F.xxhash64("_text").alias("h"), F.explode(F.array_distinct(_terms(F.col("_text")))).alias("t"))
    met = materialise(words.join(_sized(materialise(pairs.select("t").distinct(), "wanted")), "t"), "met")
    by_text = met.select("t", "h").distinct().join(copies, "h", "left").select("t", F.coalesce("copy", "h").alias("copy")).distinct()
    n_t = by_text.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    rated = pairs.join(n_t, "t").groupBy("t").agg(F.max(ratio).alias("ratio"))
    chosen = materialise(rated.filter(F.col("ratio") >= generalise).select("t", F.when(F.col("ratio") >= remove, "remove").otherwise("generalise").alias("action")), "terms")
    if chosen.isEmpty():
        return None, None
    return chosen, met.select("row", "t").join(_sized(chosen), "t", "left_semi")


def sanitise(text: Column, spans: Column) -> Column:
    """``text`` with its spans (by start) replaced by their class, or removed; overlapping ones become one.  Linear in text and spans."""
    def name(x: Column) -> Column:
        out = F.when(x["m"] == "remove", "").otherwise("<TERM>")
        for kind, what in LABELS.items():
            out = F.when(x["kind"] == kind, what).otherwise(out)
        return out

    def made(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda y: y["e"])
        reach = prefixes(ends, F.lit(0), lambda a, e: F.greatest(a, e))
        parts = bound(reach, lambda at: F.transform(x["spans"], lambda y, i: F.when(y["s"] >= at[i], F.concat(piece(x["blocks"], at[i], y["s"]), name(y))).otherwise("")))
        return F.concat(F.array_join(parts, ""), bound(F.array_max(ends), lambda e: piece(x["blocks"], e, x["n"])))

    cut = bound(F.struct(spans.alias("spans"), blocks_of(text).alias("blocks"), F.length(text).alias("n")), made)
    return F.when(F.size(spans) > 0, cut).otherwise(text)
