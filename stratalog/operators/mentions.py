"""Mentions of entity names in a corpus, and the reports built on them.

A name is found regardless of case, each of its hyphens standing for an optional
hyphen or blank, and not inside a longer run of ASCII letters and digits.

Texts never meet all names. A text is cut into tokens (runs of letters and digits,
or single other characters); a mention covers whole tokens. A token meets only the names
that can begin with it, and only there the pattern is tested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blanks of the pattern: all Unicode white space, and the separators U+001C to U+001F.
_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Characters that match another one regardless of case without sharing its lower case.
_FOLD = ("\u017f\u212a\u0130\u0131\u00b5\u03c2\u03d0\u03f5\u03d1\u03f0\u03d6\u03f1\u03d5\u1e9b",
         "skii\u03bc\u03c3\u03b2\u03b5\u03b8\u03ba\u03c0\u03c1\u03c6\u1e61")
# A token of case-free text, with the blanks and hyphens behind it.
_TOKEN = f"([a-z0-9]+|[^{_BLANK}\\-a-z0-9])[{_BLANK}\\-]*"
# The same without a group, which is faster on whole texts.
_PIECE = f"[a-z0-9]++[{_BLANK}\\-]*+|[^{_BLANK}\\-a-z0-9][{_BLANK}\\-]*+"


def _folded(c: Column) -> Column:
    """Case-free text of the same length. Lower case comes before the folding: it has a final sigma."""
    return F.translate(F.lower(F.translate(c, "\u0130", "I")), *_FOLD)


_PLAIN = r"name rlike r'^[A-Za-z0-9]+\z'"


def name_patterns(names: DataFrame) -> DataFrame:
    """(name, firsts, pattern, tokens, width) per distinct name that holds any token.

    A hyphen may be missing in the text, so its first token is the name's first or several glued: ``firsts``.
    """
    distinct = names.select("name").filter("name is not null").distinct()
    escaped = F.regexp_replace(_folded(F.col("name")), r"([!-,./:-@\[-`{-~ ])", r"\\$1")
    flexible = F.regexp_replace(escaped, "-", "[" + _BLANK.replace("\\", "\\\\") + "\\\\-]?")
    tokens = F.regexp_extract_all(_folded(F.col("name")), F.lit(_TOKEN), F.lit(1))
    rows = distinct.select(
        "name",
        F.concat(F.lit("(?iu)^(?:"), flexible, F.lit(")(?![a-z0-9])")).alias("pattern"),
        tokens.alias("_t"),
        F.length("name").alias("width"),
    ).filter(F.size("_t") > 0)
    glued = F.transform(F.sequence(F.lit(1), F.size("_t")), lambda k: F.array_join(F.slice(F.col("_t"), F.lit(1), k), ""))
    return rows.select("name", "pattern", F.size("_t").alias("tokens"), "width", F.array_distinct(glued).alias("firsts"))


def _spots(docs: DataFrame, doc: str, text: str, tokens: int, width: int) -> DataFrame:
    """(doc, at, first, ahead, inside): one row per token of every text.

    ``ahead`` is the text from the token on, as far as the longest name can reach and one character more;
    ``inside`` tells that the token follows a letter or digit.
    """
    pieces = F.regexp_extract_all(_folded(F.col(text)), F.lit(_PIECE), F.lit(0))

    def spots(p: Column) -> Column:
        return F.transform(p, lambda piece, i: F.struct(
            i.alias("at"),
            F.regexp_extract(piece, "(?s)^(?:[a-z0-9]+|.)", 0).alias("first"),
            # Single elements: a slice would copy the whole array for every token.
            F.substr(F.concat(*[F.coalesce(F.get(p, i + k), F.lit("")) for k in range(tokens + 1)]),
                     F.lit(1), F.lit(width + 1)).alias("ahead"),
            F.coalesce(F.get(p, i - 1).rlike(r"[a-z0-9]\z"), F.lit(False)).alias("inside")))

    # The array is wrapped so that the pieces are cut once per text, not once per token.
    return docs.select(doc, F.inline(F.element_at(F.transform(F.array(pieces), spots), 1)))


def _word_counts(docs: DataFrame, names: DataFrame, doc: str, text: str) -> DataFrame:
    """Mentions of names that are one run of ASCII letters and digits: the word says all, and words are counted first."""
    words = F.regexp_extract_all(_folded(F.col(text)), F.lit("[a-z0-9]++"), F.lit(0))
    wanted = names.filter(_PLAIN).select("name", F.lower("name").alias("_word")).distinct()
    met = docs.select(doc, F.explode(words).alias("_word")).join(wanted, "_word")
    return met.groupBy(doc, "name").agg(F.count(F.lit(1)).alias("mentions"))


def _pattern_counts(docs: DataFrame, names: DataFrame, doc: str, text: str) -> DataFrame:
    """Mentions of all other names: their pattern is tested where a token can begin them."""
    patterns = name_patterns(names.filter(f"not ({_PLAIN})"))
    tokens, width = patterns.agg(F.coalesce(F.max("tokens"), F.lit(1)), F.coalesce(F.max("width"), F.lit(1))).first()
    starts = patterns.select("name", "pattern", F.explode("firsts").alias("first"))
    near = _spots(docs, doc, text, tokens, width).filter(~F.col("inside")).join(starts, "first")
    matched = near.withColumn("_m", F.call_function("regexp_extract", F.col("ahead"), F.col("pattern"), F.lit(0))).filter(
        F.col("_m") != "")
    reach = F.size(F.regexp_extract_all("_m", F.lit(_PIECE), F.lit(0)))
    # The list is one document's.
    found = matched.groupBy(doc, "name").agg(F.collect_list(F.struct("at", reach.alias("k"))).alias("places"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("stop"))

    def step(acc: Column, place: Column) -> Column:
        free = place["at"] >= acc["stop"]
        return F.struct(
            (acc["n"] + F.when(free, 1).otherwise(0)).cast("bigint").alias("n"),
            F.when(free, (place["at"] + place["k"]).cast("int")).otherwise(acc["stop"]).alias("stop"),
        )

    apart = F.aggregate(F.array_sort("places"), start, step, lambda acc: acc["n"])
    return found.select(doc, "name", apart.alias("mentions"))


def count_mentions(docs: DataFrame, names: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, name, mentions) for every document and distinct name with a mention.

    Mentions of one name do not overlap; names are counted independently of each other. How a name is counted depends
    on that name alone: one of a single run of letters and digits as a word, any other by its pattern. Either way a text
    gives one row per token, whatever the names are. Rows meet the names that can begin with their token: Spark
    broadcasts the names while their measured size allows and shuffles both sides beyond that. All rows of a document
    stem from one input row, so counts are complete map-side.
    """
    return _word_counts(docs, names, doc, text).unionByName(_pattern_counts(docs, names, doc, text))


def names_with_entities(entities: DataFrame) -> DataFrame:
    """(name, n_entities): how many entities carry a name."""
    return entities.groupBy("name").agg(F.count(F.lit(1)).alias("n_entities"))


def entity_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions per document and entity id; entities of one name each get its count."""
    return mentions.join(entities.select("simulant_id", "name"), "name")


def document_index(mentions: DataFrame, entities: DataFrame, docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """One record per document with a mention: entity count, mentions, length, names by count.

    ``names`` holds the document's distinct names, most mentioned first; its size is
    bounded by the document itself.
    """
    counted = mentions.join(names_with_entities(entities), "name")
    entry = F.struct((-F.col("mentions")).alias("r"), (-F.length("name")).alias("l"), "name", "mentions", "n_entities")
    per_doc = counted.groupBy(doc).agg(
        F.sum("n_entities").alias("entity_count"),
        F.sum(F.col("mentions") * F.col("n_entities")).alias("mention_count"),
        F.transform(F.array_sort(F.collect_list(entry)),
                    lambda e: F.struct(e["name"].alias("name"), e["mentions"].alias("mentions"),
                                       e["n_entities"].alias("n_entities"))).alias("names"),
    )
    return docs.withColumn("text_length", F.length(text)).drop(text).join(per_doc, doc)


def multi_entity_report(index: DataFrame, doc: str = "doc", at_least: int = 5, shown: int = 8) -> DataFrame:
    """Documents with several entities, most first: 'name(count), …, +N more'."""
    labels = F.flatten(F.transform(
        "names", lambda e: F.array_repeat(F.concat(e["name"], F.lit("("), e["mentions"].cast("string"), F.lit(")")),
                                          F.least(e["n_entities"], F.lit(shown)).cast("int"))
    ))
    more = F.col("entity_count") - shown
    summary = F.concat(F.array_join(F.slice(labels, 1, shown), ", "),
                       F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    title = [F.substring("title", 1, 60).alias("title")] if "title" in index.columns else []
    rows = index.filter(F.col("entity_count") >= at_least).select(doc, "entity_count", summary.alias("entities"), *title)
    return rows.orderBy(F.desc("entity_count"), doc)


def top_documents(index: DataFrame, doc: str = "doc", n: int = 10) -> DataFrame:
    """The n documents that mention most entities."""
    return index.orderBy(F.desc("entity_count"), doc).limit(n)


def entity_sources(mentions: DataFrame, entities: DataFrame, doc: str = "doc") -> DataFrame:
    """Per covered entity: documents, mentions, the most mentioning and the first document.

    Reduced per name before the join with the entities. The full list per entity is the
    long table `entity_mentions`.
    """
    per_name = mentions.groupBy("name").agg(
        F.count(F.lit(1)).alias("source_count"),
        F.sum("mentions").alias("mention_count"),
        F.min(F.struct((-F.col("mentions")).alias("r"), F.col(doc).alias("d"))).alias("best"),
        F.min(doc).alias("first_source"),
    )
    rows = entities.select("simulant_id", "name").join(per_name, "name")
    return rows.select("simulant_id", "name", "source_count", "mention_count",
                       F.col("best.d").alias("top_source"), (-F.col("best.r")).alias("top_mentions"), "first_source")


def uncovered_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.join(mentions.select("name").distinct(), "name", "left_anti")


def corpus_totals(mentions: DataFrame, docs: DataFrame, entities: DataFrame, doc: str = "doc") -> DataFrame:
    """One row: documents, documents with a mention, entities, entities covered."""
    covered = entities.join(mentions.select("name").distinct(), "name", "left_semi")
    counted = {"documents": docs, "documents_with_mention": mentions.select(doc).distinct(), "entities": entities,
               "entities_covered": covered}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("measure"), "n") for m, df in counted.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    out = rows.agg(*[F.max(F.when(F.col("measure") == m, F.col("n"))).alias(m) for m in counted])
    return out.withColumn("entities_uncovered", F.col("entities") - F.col("entities_covered"))
