"""PII: patterns find protected entities, corpus co-occurrence finds the terms that give them away.

Information-theoretic sanitisation. What a term t tells of an entity e is the pointwise mutual information
PMI(e; t) = log2(p(e, t) / (p(e) p(t))), from counts of documents that hold them, near each other or not. The most that a
term can tell is IC(e) = -log2 p(e). Entities are exact ones and what they have in common: an address's domain, a number
without its last digits, a network, a card's issuer; so rare ones count as well. Copies of one passage are no evidence of their
own: PMI is discounted by (c / (c + 1))^2, c being how many documents with t have a passage around e that no other one speaks for. A term discloses e
where the discounted PMI reaches `threshold` of IC(e). Words of the name in an e-mail address count as seen with it in
`OWN_SUPPORT` of them, so a rare surname beside its owner's address is found without a second document.
In every document that holds e, every occurrence of a disclosing term is a span. `sanitise` removes it, or puts what it tells
of in its place.

All of it is DataFrame functions. Patterns run as Java regular expressions; the quantifiers that nothing
after them can shorten are possessive, and starts inside a run that failed already are skipped (the matches are
those of the plain patterns), so long runs take linear time and no deep stack. Only documents with an entity are written
and shuffled; positions are running sums over rows, so a text with many matches takes linear time, too.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, ascii_lower, cut, join_hot, row_key, sized, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match; most texts are done with so.
_HINT = {"email": "@", "ip": ".", "card": "[0-9][0-9\\x20-]{14}", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LETTERS, _OTHERS = "\\p{L}+", "[^\\p{L}]+"
#: Code points on either side of an entity that tell passages apart.
AROUND = 40
#: So many passages speak for a word of the entity's own name.
OWN_SUPPORT = 3
#: What stands for a term in a sanitised text, by what it tells of.
GENERAL = {"email": "affiliation", "ip": "network", "card": "issuer", "phone": "place"}


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _might(kind: str, text: Column) -> Column:
    return text.rlike(_HINT[kind]) if kind == "card" else F.contains(text, F.lit(_HINT[kind]))


def _matches(kind: str, text: Column) -> Column:
    return F.when(_might(kind, text), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))


def holds_entity(text: Column) -> Column:
    """Whether a text has a valid match of any kind."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.exists(_matches(k, text), partial(_valid, k)), F.lit(False)) for k in KINDS])


def _with_ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`end` beside rows (keys, _i, _gap, _len): the sum of gaps and lengths up to each row."""
    along = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(F.col("_gap") + F.col("_len")).over(along).cast("int"))


def entities(texts: DataFrame) -> DataFrame:
    """The valid matches of `texts` (_row, each once, text): _row, kind, start, end (code points), match, passage (a hash of what is around).

    Matches alternate with the gaps between them, so a match starts where all before it ends.
    """
    text = F.col("text")
    kinds = [F.struct(F.lit(k).alias("kind"), F.split(text, PATTERNS[k], -1).alias("_g"), _matches(k, text).alias("_m")) for k in KINDS]
    found = texts.select("_row", F.inline(F.array(*[F.when(_might(k, text), s) for k, s in zip(KINDS, kinds, strict=True)]))).filter(F.size("_m") > 0)
    after = F.slice("_g", F.lit(2), F.size("_m"))
    rows = found.select("_row", "kind", F.posexplode(F.arrays_zip(F.col("_g").alias("g"), F.col("_m").alias("m"), after.alias("a"))).alias("_i", "_x")).filter(F.col("_x.m").isNotNull())
    passage = F.xxhash64(F.right("_x.g", F.lit(AROUND)), F.left("_x.a", F.lit(AROUND)))
    rows = _with_ends(rows.select("_row", "kind", "_i", F.length("_x.g").alias("_gap"), F.length("_x.m").alias("_len"), F.col("_x.m").alias("match"), passage.alias("passage")), ["_row", "kind"])
    valid = reduce(lambda c, k: c.when(F.col("kind") == k, _valid(k, F.col("match"))), KINDS, F.when(F.lit(False), F.lit(False)))
    return rows.filter(valid).select("_row", "kind", (F.col("end") - F.col("_len")).alias("start"), "end", "match", "passage")


def entity_keys(found: DataFrame) -> DataFrame:
    """_row, key, general and passage: each entity, and the group that it belongs to. general is null for the entity itself."""
    low, digits = ascii_lower(F.col("match")), F.regexp_replace("match", "[^0-9]", "")
    kind = F.col("kind")
    exact = F.when(kind.isin("email", "ip"), low).otherwise(digits)
    group = F.when(kind == "email", F.substring_index(low, "@", -1)).when(kind == "ip", F.substring_index(low, ".", 3)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.left(digits, F.length(digits) - 4))
    general = reduce(lambda c, k: c.when(kind == k, GENERAL[k]), KINDS, F.when(F.lit(False), F.lit("")))
    level = F.array(F.struct(F.concat_ws(":", kind, exact).alias("key"), F.lit(None).cast("string").alias("general")), F.struct(F.concat_ws(":", F.lit("group"), kind, group).alias("key"), general.alias("general")))
    return found.select("_row", "passage", F.inline(level))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), _OTHERS))


def _least_support(threshold: float) -> int:
    c = 1
    while (c / (c + 1)) ** 2 < threshold:
        c += 1
    return c


def _tells(n_et: Column, n_e: Column, n_t: Column, n: Column, passages: Column, threshold: float) -> Column:
    discount = F.pow(passages / (passages + 1), F.lit(2.0))
    return (n > n_e) & (discount * F.log2(n_et * n / (n_e * n_t)) >= threshold * F.log2(n / n_e))


def _reaches(n_e: Column, n_t: Column, n: Column, threshold: float) -> Column:
    """Whether a term in n_t documents can tell of an entity in n_e at all: PMI is at most log2(n / n_t)."""
    return (n > n_e) & (F.log2(n / n_t) + F.lit(1e-9) >= threshold * F.log2(n / n_e))


def _signature(*cols: str) -> list[Column]:
    """Two sums of hashes: rows of `cols` in any order, to 128 bits."""
    return [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")).alias(name) for seed, name in ((1, "_a"), (2, "_b"))]


def disclosing_terms(keyed: DataFrame, hits: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(_row, term, general) for the terms that disclose an entity of document _row; general is null where the term tells of one entity.

    `keyed` is of `entity_keys`; `hits` (_row, each once, text) has the documents with an entity, `docs` (text) all.
    All that counts of an entity is in which documents it is and where passages speak for it, and of a term in which documents it is. So entities alike in that
    are one class, and terms, too, and only classes of a document meet: a list of a thousand addresses that recurs with the same thousand words
    is one pair. Entities without enough passages, terms in too few documents with an entity, and terms too common to tell of the most common entity
    are left out before. How many documents hold a term is counted over all of `docs`, for the terms in question.
    """
    least = _least_support(threshold)
    n_docs = docs.count()
    n = F.lit(max(1, n_docs))
    # A passage speaks through one document, and a document once, however many passages are in it.
    speaks = keyed.groupBy("key", "passage").agg(F.min("_row").alias("_row")).select("key", "_row", F.lit(1).alias("_p")).distinct()
    here = cut(keyed.select("_row", "key", "general").distinct().join(speaks, ["_row", "key"], "left").withColumn("_p", F.coalesce("_p", F.lit(0))))
    strict = F.min(F.struct(F.col("general").isNotNull().alias("_o"), F.col("general"))).alias("_s")
    per_key = cut(here.groupBy("key").agg(F.count("*").alias("n"), F.sum("_p").alias("_c"), F.first("general").alias("general"), *_signature("_row", "_p")).filter(F.col("_c") >= least))
    kinds = cut(per_key.groupBy("n", "_a", "_b").agg(strict).select(F.monotonically_increasing_id().alias("kind"), F.col("n").alias("n_e"), "_a", "_b", "_s"))
    per_key = cut(per_key.join(kinds.select("kind", F.col("n_e").alias("n"), "_a", "_b"), ["n", "_a", "_b"]).select("key", "n", "kind"))
    entity = join_hot(here.select("_row", "key", "_p"), per_key.select("key", "kind", F.col("n").alias("n_e")), "key", per_key.select("key", "n"))
    entity = cut(entity.groupBy("_row").agg(F.collect_set(F.struct("kind", "n_e", F.col("_p").alias("p"))).alias("_kinds")))  # what one document holds
    words = hits.join(entity.select("_row"), "_row", "left_semi").select("_row", F.explode(_terms(F.col("text"))).alias("term")).filter(F.col("term") != "")
    per_term = cut(words.groupBy("term").agg(F.count("*").alias("n_h"), *_signature("_row")).filter(F.col("n_h") >= least))
    own = cut(_own_names(hits))
    wanted = cut(per_term.select("term").union(own.select("term")).distinct())
    texts = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    counts = cut(sized(texts, wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t")))
    most = kinds.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]
    per_term = cut(per_term.join(counts, "term").filter(_reaches(F.lit(max(1, min(most, n_docs - 1))), F.col("n_t"), n, threshold)))
    classes = cut(per_term.groupBy("n_t", "n_h", "_a", "_b").agg(F.lit(1).alias("_1")).select(F.monotonically_increasing_id().alias("class"), "n_t", "n_h", "_a", "_b"))
    per_term = cut(per_term.join(classes, ["n_t", "n_h", "_a", "_b"]).select("term", "class", "n_t", F.col("n_h").alias("n")))
    narrow = per_term.select("term", "class", "n_t")
    met = words.join(F.broadcast(narrow), "term") if per_term.count() <= BROADCAST_ROWS else join_hot(words, narrow, "term", per_term.select("term", "n"))
    # Classes of a document in one array, made before they are shuffled: a document's terms are in one task.
    both = cut(met.groupBy("_row").agg(F.collect_set(F.struct("class", "n_t")).alias("_classes")).join(entity, "_row"))
    both = both.select("_row", "_classes", F.inline("_kinds")).select("_row", "kind", "n_e", "p", F.inline("_classes")).filter(_reaches(F.col("n_e"), F.col("n_t"), n, threshold))
    pairs = both.groupBy("kind", "class").agg(F.count("*").alias("n_et"), F.sum("p").alias("c")).filter(F.col("c") >= least)
    pairs = sized(sized(cut(pairs), kinds.select("kind", "n_e", "_s"), "kind", "inner"), classes.select("class", "n_t"), "class", "inner")
    told = cut(pairs.filter(_tells(F.col("n_et"), F.col("n_e"), F.col("n_t"), n, F.col("c"), threshold)).select("kind", "class", "_s"))
    told = sized(both.select("_row", "kind", "class"), told, ["kind", "class"], "inner").groupBy("_row", "class").agg(F.min("_s").alias("_s"))
    told = cut(told).join(per_term.select("class", "term"), "class").select("_row", "term", "_s.general")
    one = F.lit(1)
    names = own.join(counts, "term").filter(_tells(one, one, F.col("n_t"), n, F.lit(OWN_SUPPORT), threshold)).select("_row", "term", F.lit("name").alias("general"))
    return told.union(names).groupBy("_row", "term").agg(strict).select("_row", "term", "_s.general")


def _own_names(hits: DataFrame) -> DataFrame:
    """(_row, term): words of three letters or more of the names in e-mail addresses that the text has elsewhere, too."""
    text, rx = F.col("text"), PATTERNS["email"]
    mail = hits.filter(_might("email", text)).select("_row", F.split(text, rx, -1).alias("_g"), F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias("_m")).filter(F.size("_m") > 0)
    names = F.flatten(F.transform("_m", lambda m: F.split(F.lower(F.substring_index(m, "@", 1)), _OTHERS)))
    elsewhere = F.flatten(F.transform("_g", lambda g: F.split(F.lower(g), _OTHERS)))
    return mail.select("_row", F.explode(F.array_intersect(F.filter(names, lambda w: F.length(w) >= 3), elsewhere)).alias("term"))


def term_spans(told: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """_row, start, end, general: where the terms of `told` (_row, term, general) stand in their texts, outside of entities."""
    some = hits.join(told.select("_row").distinct(), "_row", "left_semi")
    words = some.select("_row", F.posexplode(F.arrays_zip(F.split("text", _LETTERS, -1).alias("g"), F.regexp_extract_all("text", F.lit(_LETTERS), F.lit(0)).alias("w"))).alias("_i", "_x")).filter(F.col("_x.w").isNotNull())
    words = _with_ends(words.select("_row", "_i", F.length("_x.g").alias("_gap"), F.length("_x.w").alias("_len"), F.lower("_x.w").alias("term")), ["_row"])
    at = words.join(told, ["_row", "term"]).select("_row", (F.col("end") - F.col("_len")).alias("start"), "end", "general", F.lit(True).alias("_term"))
    entity = found.select("_row", "start", "end", F.lit(None).cast("string").alias("general"), F.lit(False).alias("_term"))
    both = at.union(entity.join(told.select("_row").distinct(), "_row", "left_semi"))
    order = Window.partitionBy("_row").orderBy("start", "end", "_term")
    reach = F.max(F.when(~F.col("_term"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_ = F.min(F.when(~F.col("_term"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    clear = both.withColumn("_r", reach).withColumn("_n", next_).filter("_term").filter((F.coalesce("_r", F.lit(0)) <= F.col("start")) & (F.coalesce("_n", F.col("end")) >= F.col("end")))
    return clear.select("_row", "start", "end", "general")


def find_private(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, text and found, an array of (rank, start, end, kind, general).

    found holds the valid matches of the four kinds and then the disclosing terms (kind `term`), each
    sorted by start; starts and ends are in code points, ends exclusive; general says what a term tells of (null: of one entity).
    Terms are runs of letters, in lower case. Null texts are empty ones. Rows that repeat a doc_id
    each get their own spans; wholly repeated rows count once where an entity is looked at. Other columns are ignored.
    An empty table gives an empty one.
    """
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("_row", row_key(F.col("doc_id"), F.col("text")))
    hits = cut(d.filter(holds_entity(F.col("text"))).select("_row", "text").dropDuplicates(["_row"]))
    found = cut(entities(hits))
    told = cut(disclosing_terms(cut(entity_keys(found)), hits, d, threshold))
    base = found.select("_row", "kind", "start", "end", F.lit(None).cast("string").alias("general"))
    spans = base.unionByName(term_spans(told, hits, found).withColumn("kind", F.lit("term")))
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), F.col("kind")).cast("int")
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "general"))).alias("found"))
    empty = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string,general:string>>")
    return d.join(spans, "_row", "left").select("doc_id", "text", F.coalesce("found", empty).alias("found"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text without what is private, and found.

    Each span is replaced by its kind in brackets; a term by what it tells of ([affiliation], [network], [issuer], [place], [name]), or,
    where it tells of one entity, by [term]. Spans that overlap are replaced together, by the first one's name.
    """
    out = find_private(docs, **options)
    spans = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), F.coalesce(x["general"], x["kind"]).alias("k"))))
    rows = out.select("*", F.monotonically_increasing_id().alias("_id"))
    rows = cut(rows)  # so that the ids stay
    along = Window.partitionBy("_id").orderBy("s", "e", "k")
    parts = rows.select("_id", F.inline(spans)).withColumn("_top", F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("_n", F.sum(F.when(F.col("s") < F.col("_top"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = parts.groupBy("_id", "_n").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("k", F.struct("s", "e")).alias("k"))
    parts = parts.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "k"))).alias("_p"))
    text, begins = F.col("text"), F.concat(F.array(F.lit(0)), F.transform("_p", lambda x: x["e"]))
    pieces = F.zip_with("_p", F.slice(begins, F.lit(1), F.size("_p")), lambda x, b: F.concat(F.substring(text, b + 1, x["s"] - b), F.lit("["), x["k"], F.lit("]")))
    built = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(begins, -1) + 1, F.length(text)))
    return rows.join(parts, "_id", "left").select("doc_id", F.when(F.col("_p").isNotNull(), built).otherwise(text).alias("text"), "found")


def _digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op10_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find_private` over all documents: counts by kind, the base spans' digest and all spans."""
    out = find_private(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"] != "term")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"))
