"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Base spans come from patterns: e-mail addresses, IP addresses, card numbers and
telephone numbers.  Each distinct value is a protected entity.  All words of the
documents that hold an entity are its terms.  Over the whole corpus, the pointwise mutual information
of a term t and an entity e, log2(N c(t,e) / (df(t) df(e))), says how much of
the entity's information log2(N / df(e)) a reader of t gains; N, c and df count
documents.  A term that gives away at least `REMOVE` of it is removed, one that
gives away at least `GENERALISE` is replaced by its kind of word, at every place of those
documents.  Co-occurrence
in a single document is no evidence, so at least `SUPPORT` documents are needed.

All of it is DataFrame expressions, joins and aggregates: no Python on the rows.

Defined results: a null text counts as empty and stays null; matches do not
overlap within a kind, and failing ones are dropped; equal spans of several
kinds all count; a term span that overlaps a base span is none; ties among spans
go by kind as listed; rows that repeat an id and text are treated alike, rows
that only repeat an id each by their text; a text of many spans takes time in
proportion to its length and spans.  Other columns are not read, or pass
through `rewrite` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let, match_positions
from .common import written

#: Parts of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.6, 0.9
SUPPORT = 2

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["removed", "generalised"]

#: The patterns of the base kinds.  Repeats are possessive and
#: a match begins where a run of its characters does, or where the last match
#: ended; both only spare the engine useless attempts.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_WORD = r"\p{L}\p{N}"
#: Stands for a letter or digit of a base span; itself none.
_MASK = "\uE000"
_SIGN = 0xE010
_SHOWN = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[WORD]", "[NUMBER]"]
_CHUNK = 512
#: Entity groups of a document that meet its words in one task.
_BLOCK = 64
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _holds(kind: str, match: Column) -> Column:
    """The condition on a match of the kind's pattern."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    return text.contains("+")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> of the base kinds, by start, then kind.

    Places are code points from 0, the end exclusive; ``kind`` numbers `KINDS`.
    """
    none = F.array().cast(_SPAN)

    def of_kind(number: int, kind: str) -> Column:
        hits = F.filter(match_positions(text, PATTERNS[kind]), lambda h: _holds(kind, h["m"]))
        spans = F.transform(hits, lambda h: F.struct(
            h["at"].cast("int").alias("start"), F.lit(number).alias("kind"),
            (h["at"] + F.length(h["m"])).cast("int").alias("end"), h["m"].alias("value")))
        return F.when(_may_hold(kind, text), spans).otherwise(none)

    return F.array_sort(F.concat(*[of_kind(n, k) for n, k in enumerate(KINDS)]))


def _written_as(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS + ADDED])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _chunks(text: Column) -> Column:
    """The text cut into chunks, so that no part of it is sought from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _part(chunks: Column, begin: Column, end: Column) -> Column:
    """The text from ``begin`` to ``end``, put together from its chunks."""
    first, last = (F.floor(p / _CHUNK).cast("int") for p in (begin, end - 1))
    offset = begin % _CHUNK + 1
    whole = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return (F.when(begin >= end, "").when(first == last, F.substring(
        F.get(chunks, first), offset, end - begin)).otherwise(F.concat(
            F.substring(F.get(chunks, first), offset, F.lit(_CHUNK)), whole,
            F.substring(F.get(chunks, last), F.lit(1), end - last * _CHUNK))))


def _exchanged(text: Column, spans: Column, change: Callable[[Column, Column], Column]) -> Column:
    """The text with ``change(part, span)`` for each of the sorted spans, none of which overlap."""
    def cut(t: Column, spans: Column, chunks: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
            return let(_part(chunks, s["start"], s["end"]), lambda inside: F.concat(
                _part(chunks, before, s["start"]), change(inside, s)))

        return F.concat(F.array_join(F.transform(spans, piece), ""), _part(
            chunks, F.get(spans, F.size(spans) - 1)["end"], F.length(t)))

    # text and spans are what other expressions give: each is evaluated once
    both = F.struct(text.alias("t"), spans.alias("s"))
    return let(both, lambda x: F.when(F.size(x["s"]) == 0, x["t"]).otherwise(
        let(_chunks(x["t"]), lambda chunks: cut(x["t"], x["s"], chunks))))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _masked(text: Column, spans: Column) -> Column:
    """The text, as long, with `_MASK` for letters and digits of base spans.

    Spans of a kind do not overlap, so the text is cut once for each kind.
    """
    def by_kind(spans: Column) -> Column:
        masked = F.translate(text, _MASK, " ")
        for kind in range(len(KINDS)):
            masked = _exchanged(masked, _of_kind(spans, kind), lambda part, _: F.regexp_replace(
                part, f"[{_WORD}]", _MASK))
        return masked

    return let(spans, by_kind)


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, f"[^{_WORD}]+"), F.lower))


def _entities(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the text), spans and terms of every document.

    Terms are the distinct words outside the spans, of documents with any span;
    a word that is partly in a span is none.
    """
    spans = docs.select("doc_id", F.xxhash64("text").alias("same"), "text",
                        base_spans(F.col("text")).alias("spans"))
    outside = F.regexp_replace(
        _masked(F.col("text"), F.col("spans")),
        f"(?<![{_WORD}{_MASK}])[{_WORD}]*+{_MASK}[{_WORD}{_MASK}]*+", " ")
    terms = F.when(F.size("spans") > 0, F.array_remove(_distinct_words(outside), ""))
    return written(spans.select("doc_id", "same", "spans", terms.alias("terms")), "entities")


def _same_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` and ``right``, whose keys are renamed, joined by document."""
    keys = right.withColumnsRenamed({"doc_id": "_id", "same": "_of"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_of"))
    return left.join(keys, on, how).drop("_id", "_of")


def _terms(entities: DataFrame) -> DataFrame:
    """doc_id, same, entities (distinct) and terms of each document with an entity, once."""
    held = entities.where(F.size("spans") > 0).select(
        "doc_id", "same", F.array_distinct(F.transform("spans", lambda s: F.concat(
            s["kind"], F.lit(":"), F.lower(s["value"])))).alias("entities"), "terms")
    repeated = written(held.groupBy("doc_id", "same").agg(F.count(F.lit(1)).alias("rows")).where(
        F.col("rows") > 1).select("doc_id", "same"), "repeated")
    return _same_document(held, repeated, "left_anti").unionAll(
        _same_document(held, repeated, "left_semi").dropDuplicates(["doc_id", "same"]))


def _groups(terms: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(entity, group, df_entity), and (doc_id, same, groups) of documents with any.

    Entities of the same documents meet every word equally often: they are one
    group, known by its number of documents and two sums of their hashes.
    Entities of fewer than ``support`` documents have no term, and are in none.
    """
    held = terms.select("doc_id", "same", F.explode("entities").alias("entity"))
    sums = [F.bit_xor(F.xxhash64(F.lit(n), "doc_id", "same")) for n in (1, 2)]
    n = F.count(F.lit(1))
    of_entity = written(held.groupBy("entity").agg(
        n.alias("df_entity"), F.concat_ws(":", n, *sums).alias("group")).where(
        F.col("df_entity") >= support), "entity-documents")
    known = written(held.join(of_entity, "entity").groupBy("doc_id", "same").agg(
        F.collect_set("group").alias("groups")), "document-entities")
    return of_entity, known


def _together(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(group, term) of every document; many groups of one are dealt over many tasks."""
    words = terms.select("doc_id", "same", "terms")
    few = _same_document(words, known.where(F.size("groups") <= _BLOCK)).select("groups", "terms")
    many = _same_document(words, known.where(F.size("groups") > _BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / _BLOCK).cast("int"))
    dealt = many.select("doc_id", "same", "groups", "terms", F.explode(blocks).alias("block")).select(
        "doc_id", "same", "block", F.slice("groups", F.col("block") * _BLOCK + 1, F.lit(_BLOCK))
        .alias("groups"), "terms").repartition("doc_id", "same", "block").select("groups", "terms")
    return few.unionAll(dealt).select(F.explode("groups").alias("group"), "terms").select(
        "group", F.explode("terms").alias("term"))


def _disclosing(docs: DataFrame, terms: DataFrame, of_entity: DataFrame, known: DataFrame, *,
                generalise: float, remove: float, support: int) -> DataFrame:
    """group, term, share, kind: the terms that give away enough of a group's entities."""
    of_group = of_entity.groupBy("group").agg(F.max("df_entity").alias("df_entity"))
    pairs = written(_together(terms, known).groupBy("group", "term").agg(
        F.count(F.lit(1)).alias("both")).where(F.col("both") >= support), "entity-terms")
    wanted = written(pairs.select("term").distinct(), "entity-words")
    of_term = docs.select(F.explode(_distinct_words(F.col("text"))).alias("term")).groupBy(
        "term").agg(F.count(F.lit(1)).alias("df_term")).join(wanted, "term")
    documents = docs.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    rated = pairs.join(of_group, "group").join(of_term, "term").withColumn("n", documents)
    gained = F.log2(F.col("n") * F.col("both") / (F.col("df_term") * F.col("df_entity")))
    share = gained / F.log2(F.col("n") / F.col("df_entity"))
    return rated.where(F.col("n") > F.col("df_entity")).select(
        "group", "term", share.alias("share")).where(F.col("share") >= generalise).withColumn(
        "kind", F.lit(len(KINDS)) + (F.col("share") < remove).cast("int"))


def disclosing(docs: DataFrame, terms: DataFrame, *, generalise: float = GENERALISE,
               remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """entity, term, share, kind: the terms that give away enough of an entity.

    ``terms`` is `_terms` of ``docs``.  Document counts of words are taken over
    all texts; each task reduces its words before they are shuffled.
    """
    of_entity, known = _groups(terms, support)
    return of_entity.select("entity", "group").join(_disclosing(
        docs, terms, of_entity, known, generalise=generalise, remove=remove, support=support),
        "group").select("entity", "term", "share", "kind")


def _added(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, same, added: the spans that the method adds, documents with any only."""
    terms = _terms(entities)
    of_entity, known = _groups(terms, SUPPORT)
    chosen = written(_disclosing(
        docs, terms, of_entity, known, generalise=GENERALISE, remove=REMOVE,
        support=SUPPORT).select("group", "term", "kind"), "disclosing")
    # a document's chosen terms, and which of them are its words
    found = known.select("doc_id", "same", F.explode("groups").alias("group")).join(
        chosen, "group").groupBy("doc_id", "same", "term").agg(F.min("kind").alias("kind"))
    marks = written(found.groupBy("doc_id", "same").agg(F.collect_list(
        F.struct("term", F.col("kind").cast("int").alias("kind"))).alias("marks")), "marks")
    # one merge join by document; what follows is grouped within its partitions
    texts = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("same"), "text")
    text = F.col("text")
    words = match_positions(_masked(text, base_spans(text)),
                            f"(?<![{_WORD}{_MASK}])[{_WORD}]++(?!{_MASK})")
    places = F.transform(words, lambda h: F.struct(
        F.lower(h["m"]).alias("term"), F.lit(None).cast("int").alias("kind"),
        h["at"].cast("int").alias("start"),
        (h["at"] + F.length(h["m"])).cast("int").alias("end")))
    wanted = F.transform("marks", lambda m: F.struct(
        m["term"].alias("term"), m["kind"].alias("kind"), F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("end")))
    hits = _same_document(texts, marks.hint("merge")).select(
        "doc_id", "same", F.inline(F.concat(places, wanted))).groupBy(
        "doc_id", "same", "term").agg(F.min("kind").alias("kind"), F.collect_set(F.when(
            F.col("start").isNotNull(), F.struct("start", "end"))).alias("places")).where(
        F.col("kind").isNotNull()).select("doc_id", "same", "kind", F.inline("places"))
    return written(hits.groupBy("doc_id", "same").agg(F.collect_list(F.struct(
        "start", "kind", "end", F.lit(None).cast("string").alias("value"))).alias("added")),
        "added")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays as of `base_spans`; spans: all) of every document."""
    docs = docs.select("doc_id", "text")
    entities = _entities(docs)
    added = _added(docs, entities)
    base = entities.select("doc_id", "same", F.col("spans").alias("base"))
    on = F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("same") == F.col("added_same"))
    return base.join(added.select(F.col("doc_id").alias("added_id"),
                                  F.col("same").alias("added_same"), "added"), on, "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce(
            "added", F.array().cast(_SPAN)))).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, base_sha256 and spans of every document."""
    def count(number: int) -> Column:  # a span's kind is the place of its name in KINDS
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    return find(docs).select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(_written_as(F.col("base")), 256).alias("base_sha256"),
        _written_as(F.col("spans")).alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; overlapping spans become one.

    In a text as long, every span's first letter becomes the sign of its kind, unless
    it lies in a span already, and the others `_MASK`.  A sign with the masks behind
    it is then all of overlapping spans, and these places are cut from the text.
    """
    signs = "".join(chr(_SIGN + k) for k in range(len(_SHOWN)))
    def signed(spans: Column) -> Column:
        masked = F.translate(text, _MASK + signs, " " * (1 + len(signs)))
        for kind in range(len(KINDS + ADDED)):
            masked = _exchanged(masked, _of_kind(spans, kind), lambda part, _, kind=kind: F.concat(
                F.when(part.rlike(f"^[{_MASK}{signs}]"), F.substring(part, 1, 1))
                .when(part.rlike(r"^\p{N}+$"), _sign(kind, number=True))
                .otherwise(_sign(kind)), F.repeat(F.lit(_MASK), F.length(part) - 1)))
        return masked

    places = F.transform(match_positions(let(spans, signed), f"[{signs}]{_MASK}*+"), lambda h: F.struct(
        h["at"].alias("start"), (h["at"] + F.length(h["m"])).alias("end"), h["m"].alias("m")))
    return _exchanged(text, places, lambda _, s: F.element_at(
        F.array(*[F.lit(x) for x in _SHOWN]), F.ascii(s["m"]) - _SIGN + 1))


def _sign(kind: int, number: bool = False) -> Column:
    """A letter for a kind as it is shown; a generalised number has one of its own."""
    last = len(KINDS + ADDED) - 1
    return F.lit(chr(_SIGN + kind + (number and kind == last)))


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with sanitised texts.

    Only documents with an entity are joined with their terms, so only their
    texts are shuffled.
    """
    columns = docs.columns
    added = _added(docs.select("doc_id", "text"), _entities(docs.select("doc_id", "text")))
    marked = docs.withColumn("_base", base_spans(F.col("text")))
    clean = marked.where(F.size("_base") == 0).select(*columns)
    other = marked.where(F.size("_base") > 0).withColumn("_same", F.xxhash64("text"))
    joined = other.join(added.select(F.col("doc_id").alias("_id"), F.col("same").alias("_of"),
                                     F.col("added").alias("_added")),
                        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_of")),
                        "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_added", F.array().cast(_SPAN))))
    return clean.unionAll(joined.withColumn("text", _replaced(F.col("text"), spans)).select(*columns))
