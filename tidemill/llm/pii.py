"""Personal data in whole texts, with information-theoretic sanitisation: DataFrame functions only.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are found by patterns and checks.  Each found value is a protected
entity.  Corpus co-occurrence then estimates how strongly a term reveals it: with p(t) the share of documents that hold
the term, p(e) the share that hold the entity and p(t|e) the share of the entity's contexts that hold the term, where a
context is a whole document with the entity's own mentions left out,

    PMI(t; e) = ln(p(t|e) / p(t)),   IC(e) = -ln p(e).

A term that stands in ``SUPPORT`` or more different contexts of the entity is generalised from PMI >= ``DISCLOSURE`` *
IC(e) on (kind ``term``), and removed once it gives the entity away altogether, PMI >= IC(e) (kind ``gone``), in every
document that holds the entity.  Equal contexts count once, so copies of a document add no evidence.

Spans count code points, the end exclusive.  The patterns stand here with possessive quantifiers and with look-behind on
the border of a run; they match what the plain patterns match, in time linear in the text.

Defined results: a null text counts as empty (no spans; ``sanitise`` keeps it null); a null key takes part in counts and
keeps its row in ``sanitise``; repeated rows give repeated rows; ``find`` carries the key alone, ``sanitise`` every
column, whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.cut import cut

KINDS = ("email", "ip", "card", "phone", "term", "gone")
BASE = KINDS[:4]

# The base patterns. Each begins where no run of its first characters is cut, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}

#: Different contexts that a term needs, and the share of IC(e) that discloses.
SUPPORT, DISCLOSURE = 3, 0.6
#: Not read here: characters of context of an earlier rule, which the reference of a test still names.
CONTEXT = 100
#: Candidate terms that are broadcast at most; more are joined by a shuffle.
BROADCAST = 50_000
WORD = r"\p{L}[\p{L}\p{M}]++"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, size - i, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1"), r"\."), lambda part: F.when(F.length(part) <= 3, part.cast("int") <= 255).otherwise(F.lit(False)))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals (or greatest values) of an array: in each round an item joins the one 1, 2, 4 ... places before it."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    before = lambda now, i, k: F.get(now, i - F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(rounds, values, lambda now, k: F.transform(now, lambda x, i: F.coalesce(join(x, before(now, i, k)), x)))


def located(text: Column, pattern: str, kind: Column) -> Column:
    """All matches of a pattern as spans: the pieces between matches give their places, as running totals of lengths."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(pieces, values, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull())

    def spans(own: Column) -> Column:
        ends = _running(F.transform(own, lambda x: (x["gap"] + F.length(x["value"])).cast("long")), lambda a, b: a + b)
        span = lambda x, end: F.struct(kind.alias("kind"), (end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.zip_with(own, ends, span)

    return _let(pairs, spans)


def _of_kind(text: Column, kind: str) -> Column:
    needed = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9][0-9 -]{4}")
    return F.when(needed, F.filter(located(text, PATTERNS[kind], F.lit(kind)), lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(SPANS))


def _base(text: Column) -> Column:
    """Valid base spans of a text, kind by kind."""
    return F.concat(*[_of_kind(text, kind) for kind in BASE])


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _entity(span: Column) -> Column:
    """One name for a protected value, however it is written."""
    return F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(F.concat(span["kind"], F.lit(":"), _digits(span["value"])))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _context_words(text: Column, spans: Column) -> Column:
    """Distinct words of a text as ``word entity``; the entity is that in whose mentions alone the word stands, else empty.

    Strings, as Spark finds equal structs by comparing all with all.
    """
    outside = F.transform(_words(F.regexp_replace(text, PATTERNS["email"], " ")), lambda w: F.concat(w, F.lit(" ")))  # other kinds hold no letters
    emails = F.filter(spans, lambda s: s["kind"] == "email")
    inside = F.flatten(F.transform(emails, lambda s: F.transform(_words(s["value"]), lambda w: F.concat(w, F.lit(" "), _entity(s)))))
    sorted_ = F.sort_array(F.array_distinct(F.concat(outside, inside)))  # a word's strings lie together, as a blank sorts before letters
    before, after = F.slice(F.concat(F.array(F.lit("")), sorted_), F.lit(1), F.size(sorted_)), F.slice(sorted_, F.lit(2), F.greatest(F.size(sorted_), F.lit(1)))
    with_before = F.zip_with(sorted_, before, lambda x, y: F.struct(x.alias("it"), y.alias("before")))
    word = lambda x: F.substring_index(x, " ", 1)
    once = lambda x, y: (word(x["before"]) != word(x["it"])) & (word(F.coalesce(y, F.lit(""))) != word(x["it"]))
    return F.array_distinct(F.zip_with(with_before, after, lambda x, y: F.when(once(x, y), x["it"]).otherwise(F.concat(word(x["it"]), F.lit(" ")))))


def disclosing(texts: DataFrame, held: DataFrame) -> DataFrame:
    """``entity, term, kind`` of the terms that reveal an entity.

    ``texts`` has one ``text`` a document; ``held`` has ``row, text, spans`` of those with base spans.
    """
    held = held.select(F.md5("text").alias("id"), "row", "text", "spans")
    mentions = cut(held.select("id", "row", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct())
    having = mentions.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("having"))
    contexts = mentions.select("id", "entity").distinct()
    entities = cut(contexts.groupBy("entity").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= SUPPORT))
    own = contexts.join(entities, "entity", "left_semi").groupBy("id").agg(F.collect_set("entity").alias("entities"))  # those of one text
    context = held.dropDuplicates(["id"]).join(own, "id").select("entities", _context_words(F.col("text"), F.col("spans")).alias("words"))
    each = context.select("entities", F.explode("words").alias("word")).select("entities", F.substring_index("word", " ", 1).alias("term"), F.substring_index("word", " ", -1).alias("own"))
    near = each.select(F.explode("entities").alias("entity"), "term", "own").where("own != entity")
    pairs = cut(near.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT).join(entities, "entity"))
    terms = pairs.select("term").distinct()
    few = terms.limit(BROADCAST + 1).count() <= BROADCAST
    holding = texts.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("holding"))
    holding = cut(holding.join(F.broadcast(terms) if few else terms, "term"))
    holding = F.broadcast(holding) if few else holding
    total = F.lit(texts.count())
    pmi = F.log(F.col("both") / F.col("contexts")) - F.log(F.col("holding") / total)
    information = -F.log(F.col("having") / total)
    scored = pairs.join(holding, "term").join(having, "entity").select("entity", "term", pmi.alias("pmi"), information.alias("information"))
    kept = scored.where((F.col("information") > 0) & (F.col("pmi") >= DISCLOSURE * F.col("information")))
    return kept.select("entity", "term", F.when(F.col("pmi") >= F.col("information"), "gone").otherwise("term").alias("kind"))


def _row(key: str, text: str) -> Column:
    """Tells rows apart by key and text, so that repeated rows agree."""
    return F.concat_ws(":", F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))


def _spotted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, row, text, spans``: base spans of every row; the text only where there may be any."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return cut(docs.select(F.col(key).alias("key"), _row(key, text).alias("row"), F.when(plain.rlike("@|[0-9]"), plain).alias("text"), _base(plain).alias("spans")))


def _more(docs: DataFrame, spotted: DataFrame, text: str) -> DataFrame:
    """``row, more``: term spans of the rows that have any, one row each."""
    mentions = spotted.where(F.size("spans") > 0).select("row", F.explode(F.transform("spans", _entity)).alias("entity"))
    terms = disclosing(docs.select(F.col(text).alias("text")), spotted.where(F.size("spans") > 0).select("row", "text", "spans"))
    marked = mentions.select("row", "entity").distinct().join(terms, "entity").groupBy("row", "term").agg(F.min("kind").alias("kind"))
    by_row = marked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("marks"))  # terms of one text
    mark = lambda s: F.struct(F.col("marks")[F.lower(s["value"])].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    found = F.filter(F.transform(located(F.col("text"), WORD, F.lit("term")), mark), lambda s: s["kind"].isNotNull())
    return cut(spotted.where(F.size("spans") > 0).dropDuplicates(["row"]).join(by_row, "row").select("row", found.alias("more")))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with the term spans of their ``row``: broadcast where these are few, else by a shuffle."""
    return rows.join(F.broadcast(more) if more.limit(BROADCAST + 1).count() <= BROADCAST else more, more.columns[0], "left")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans`` (array of kind, start, end) of every whole text."""
    spotted = _spotted(docs, key, text)
    rows = _with_more(spotted.select("key", "row", "spans"), _more(docs, spotted, text))
    return rows.select(F.col("key").alias(key), ordered(F.concat("spans", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns, personal data masked and disclosing terms generalised or removed."""
    row, more = ("_" * max(map(len, docs.columns)) + name for name in ("row", "more"))
    found = _more(docs, _spotted(docs, key, text), text).toDF(row, more)
    spans = ordered(F.concat(_base(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(more), F.array().cast(SPANS))))
    out = F.when(F.col(text).isNotNull(), masked(F.col(text), spans))
    return _with_more(docs.withColumn(row, _row(key, text)), found).withColumn(text, out).select(*docs.columns)


def masked(text: Column, spans: Column) -> Column:
    """The text with its spans replaced; of overlapping spans the first stands for all.

    The text is cut by places in a coding of four bytes a character, so that a cut costs what it yields.
    """
    mask = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    first = F.encode(F.lit("|"), "UTF-32")  # before a piece, so that no character of its own is taken for a mark of order

    def cut_out(whole: Column, start: Column, size: Column) -> Column:
        piece = F.substring(whole, (4 * start + 1).cast("int"), (4 * size).cast("int"))
        return F.substring(F.decode(F.concat(first, piece), "UTF-32"), F.lit(2), size.cast("int"))

    def joined(own: Column) -> Column:
        def pieces(reached: Column) -> Column:
            at = lambda i: F.coalesce(F.get(reached, i - 1), F.lit(0).cast("long"))
            gap = lambda s, i: cut_out(own["whole"], at(i), s["start"] - at(i))
            return F.transform(own["spans"], lambda s, i: F.when(s["start"] >= at(i), F.concat(gap(s, i), mask[s["kind"]])).otherwise(F.lit("")))

        ends = _running(F.transform(own["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return _let(ends, lambda reached: _let(F.coalesce(F.get(reached, F.size(reached) - 1), F.lit(0).cast("long")), lambda last: F.concat(
            F.array_join(pieces(reached), ""), cut_out(own["whole"], last, F.length(own["whole"]) / 4 - last))))

    return F.when(F.size(spans) > 0, _let(F.struct(F.encode(text, "UTF-32").alias("whole"), spans.alias("spans")), joined)).otherwise(text)
