"""Queries over documents: HTML to text, mention index, reports, citation backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import citations
from stratalog.operators import backfill, mentions
from stratalog.plans import jobs
from stratalog.plans.registry import query
from stratalog.plans.standins import StandIns, dealt
from stratalog.sources import corpus as corpora

_ENTITIES = {"&amp;": "&", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": "\xa0"}


def _visible_sql() -> str:
    bare = r"regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', '<x>', 'g')"
    marked = f"regexp_replace({bare}, '(<[^>]*>)+', chr(1), 'g')"
    out = f"replace(trim({marked}, chr(1)), chr(1), ' ')"
    for code, char in [e for e in _ENTITIES.items() if e[0] != "&amp;"] + [("&amp;", "&")]:
        out = f"replace({out}, '{code}', '{char}')"
    return out


@query(f"""with page_text as (select page_id, {_visible_sql()} as text from pages)
    select page_id, length(text) as n_chars, md5(text) as digest from page_text where length(text) >= 100""")
def page_texts(t: StandIns) -> DataFrame:
    rows = corpora.corpus_texts(dealt(t["pages"].select("page_id", "html")))
    return rows.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


_WORDS = """word_count as (
    select doc_id, w.word, count(*) as n from (
        select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as word from documents) w
    where w.word <> '' group by 1, 2)"""
_FILE = "cast(doc_id as varchar) || case when doc_id % 3 = 0 then '.pdf.html' else '.html' end"
_HITS = f"""{_WORDS},
    word as (select distinct name from word_names),
    hit as (select {_FILE} as file, w.name, c.n as mentions from word w join word_count c on c.word = lower(w.name))"""


def _word_hits(t: StandIns) -> DataFrame:
    return mentions.count_mentions(dealt(t["corpus"]), t["word_names"], "file")


@query(f"with {_HITS} select * from hit")
def word_mentions(t: StandIns) -> DataFrame:
    return _word_hits(t)


_MARK = r"regexp_replace({c}, '([A-Za-z0-9]+)', chr(1) || '\1' || chr(2), 'g')"


@query(rf"""with marked as (select {_FILE} as file, {_MARK.format(c="text")} as text from documents),
    pair as (select distinct name, split_part(name, '-', 1) as a, split_part(name, '-', 2) as b from pair_names),
    pattern as (select name, '(?i)' || chr(1) || a || b || chr(2) || '|' || chr(1) || a || chr(2) || '[\s\-]' || chr(1) || b || chr(2) as p
                from pair),
    counted as (select file, name, len(regexp_extract_all(text, p)) as mentions from marked, pattern)
    select * from counted where mentions > 0""")
def hyphenated_mentions(t: StandIns) -> DataFrame:
    return mentions.count_mentions(dealt(t["corpus"]), t["pair_names"], "file")


@query(f"with {_HITS} select h.file, w.simulant_id, h.name, h.mentions from hit h join word_names w on w.name = h.name")
def entity_mentions(t: StandIns) -> DataFrame:
    return mentions.entity_mentions(_word_hits(t), t["word_names"]).select("file", "simulant_id", "name", "mentions")


_INDEX = f"""{_HITS},
    carried as (select name, count(*) as n_entities from word_names group by name),
    counted as (select h.*, c.n_entities, row_number() over (
        partition by file order by mentions desc, length(h.name) desc, h.name) as place from hit h join carried c on c.name = h.name),
    record as (select file, sum(n_entities)::bigint as entity_count, sum(mentions * n_entities)::bigint as mention_count,
                      string_agg(name || ':' || mentions, ',' order by place) as listed from counted group by file)"""


def _index(t: StandIns) -> DataFrame:
    return mentions.document_index(_word_hits(t), t["word_names"], t["corpus"], "file")


@query(f"""with {_INDEX} select r.file, c.title, length(c.text) as text_length, entity_count, mention_count, listed
    from record r join corpus c on c.file = r.file""")
def document_index(t: StandIns) -> DataFrame:
    listed = F.array_join(F.transform("names", lambda e: F.concat(e["name"], F.lit(":"), e["mentions"].cast("string"))), ",")
    return _index(t).select("file", "title", F.col("text_length").cast("bigint").alias("text_length"), "entity_count",
                            "mention_count", listed.alias("listed"))


@query(f"""with {_INDEX},
    repeated as (select file, name, mentions, place, unnest(range(n_entities)) as copy from counted),
    numbered as (select *, row_number() over (partition by file order by place, copy) as k from repeated)
    select r.file, r.entity_count,
        (select string_agg(n.name || '(' || n.mentions || ')', ', ' order by n.k) from numbered n where n.file = r.file and n.k <= 8)
            || case when r.entity_count > 8 then ' +' || (r.entity_count - 8) || ' more' else '' end as entities,
        substr(c.title, 1, 60) as title
    from record r join corpus c on c.file = r.file where r.entity_count >= 5""")
def multi_entity_report(t: StandIns) -> DataFrame:
    return mentions.multi_entity_report(_index(t), "file")


@query(f"with {_INDEX} select file, entity_count from record order by entity_count desc, file limit 10")
def top_documents(t: StandIns) -> DataFrame:
    return mentions.top_documents(_index(t), "file").select("file", "entity_count")


@query(f"""with {_HITS}
    select w.simulant_id, w.name, count(*) as source_count, sum(h.mentions)::bigint as mention_count,
           arg_min(h.file, (-h.mentions, h.file)) as top_source, max(h.mentions) as top_mentions, min(h.file) as first_source
    from word_names w join hit h on h.name = w.name group by 1, 2""")
def entity_sources(t: StandIns) -> DataFrame:
    return mentions.entity_sources(_word_hits(t), t["word_names"], "file")


@query(f"with {_HITS} select simulant_id, name from word_names where name not in (select name from hit)")
def uncovered_entities(t: StandIns) -> DataFrame:
    return mentions.uncovered_entities(_word_hits(t), t["word_names"]).select("simulant_id", "name")


@query(f"""with {_HITS}
    select (select count(*) from documents) as documents, (select count(distinct file) from hit) as documents_with_mention,
           (select count(*) from word_names) as entities,
           (select count(*) from word_names where name in (select name from hit)) as entities_covered,
           (select count(*) from word_names where name not in (select name from hit)) as entities_uncovered""")
def corpus_totals(t: StandIns) -> DataFrame:
    return mentions.corpus_totals(_word_hits(t), t["corpus"], t["word_names"], "file")


_DOC_TITLE = r"""[y for y in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split(text, chr(10))]
    if length(y) > 10 and length(y) < 200 and not starts_with(y, 'http')][1]"""


@query(rf"""select doc_id, {_DOC_TITLE} as title,
        'Author ' || lang || ' et al. - ' || (2000 + doc_id % 20) || ' - On ' || source as file_title,
        'Author ' || lang || ' et al.' as authors, cast(2000 + doc_id % 20 as int) as year, 'On ' || source as work
    from documents""")
def document_fields(t: StandIns) -> DataFrame:
    year = (2000 + F.col("doc_id") % 20).cast("string")
    name = F.concat(F.lit("Author "), F.col("lang"), F.lit(" et al. - "), year, F.lit(" - On "), F.col("source"),
                    F.lit(".pdf.html"))
    return t["documents"].select(
        "doc_id", citations.document_title(F.col("text")).alias("title"), citations.file_title(name).alias("file_title"),
        citations.file_authors(name).alias("authors"), citations.file_year(name).alias("year"),
        citations.file_work_title(name).alias("work"))


@query(r"""select reference_id, nullif(regexp_replace(regexp_extract(substr(reference_text, 1, 3000), '(10\.\d{4,}/[^\s,;)]+)', 1), '\.+$', ''), '') as doi
    from "references" """)
def document_dois(t: StandIns) -> DataFrame:
    return t["references"].select("reference_id", citations.document_doi(F.col("reference_text")).alias("doi"))


_BEST = f"""{_HITS},
    good as (select file from corpus where not regexp_matches(title, 'Dashboard|Database|Registry|Dataset|Wikipedia')),
    best as (select name, arg_min(file, (-mentions, file)) as file, max(mentions) as mentions
             from hit where file in (select file from good) group by name)"""
_CITED = rf"""cited as (
    select c.file, coalesce(k.title, {_DOC_TITLE}, replace(replace(c.file, '.html', ''), '.pdf', '')) as title,
           k.authors, k.year, coalesce(k.doi, case when k.file is null then
               nullif(regexp_replace(regexp_extract(substr(text, 1, 3000), '(10\.\d{{4,}}/[^\s,;)]+)', 1), '\.+$', ''), '') end) as doi,
           case when k.file is null then 'general' else k.reference_type end as reference_type
    from corpus c left join curated k on k.file = c.file)"""


def _best(t: StandIns) -> DataFrame:
    return backfill.best_sources(_word_hits(t), t["corpus"].select("file", "title"))


@query(f"with {_BEST} select * from best")
def best_sources(t: StandIns) -> DataFrame:
    return _best(t)


@query(f"with {_CITED} select * from cited")
def resolved_citations(t: StandIns) -> DataFrame:
    rows = backfill.resolved_citations(t["corpus"].select("file"), t["corpus"].select("file", "text"), t["curated"])
    return rows.select("file", "title", "authors", "year", "doi", "reference_type")


_NEW = f"""{_BEST}, {_CITED},
    bare as (select w.simulant_id, b.file from word_names w join best b on b.name = w.name
             where w.simulant_id not in (select simulant_id from word_references)),
    fresh as (select 'R' || lpad(cast(row_number() over (order by b.simulant_id) + (
                     select coalesce(max(try_cast(substr(reference_id, 2) as bigint)), 0) from word_references) as varchar), 3, '0')
                     as reference_id, b.simulant_id, c.title, c.authors, c.year, c.doi, c.reference_type
              from bare b join cited c on c.file = b.file)"""


def _new(t: StandIns) -> DataFrame:
    return backfill.new_citations(t["word_names"], t["word_references"], _best(t), t["corpus"].select("file", "text"),
                                  t["curated"])


@query(f"with {_NEW} select * from fresh")
def new_citations(t: StandIns) -> DataFrame:
    return _new(t).select("reference_id", "simulant_id", "title", "authors", "year", "doi", "reference_type")


@query(f"""with {_NEW}, after_ as (select simulant_id from word_references union all select simulant_id from fresh)
    select 'before' as child, (select count(distinct simulant_id) from word_references) as covered,
        (select count(*) from word_names where simulant_id not in (select simulant_id from word_references)) as missing,
        (select count(*) from word_names) as total
    union all select 'after', (select count(distinct simulant_id) from after_),
        (select count(*) from word_names where simulant_id not in (select simulant_id from after_)), (select count(*) from word_names)""")
def coverage_change(t: StandIns) -> DataFrame:
    before = t["word_references"]
    return backfill.coverage_change(t["word_names"], before, before.unionByName(_new(t)))


@query(f"""with {_NEW}, after_ as (select simulant_id from word_references union all select simulant_id from fresh)
    select simulant_id, count(*) as n from after_ group by simulant_id""")
def backfilled_references(t: StandIns) -> DataFrame:
    """The whole index job, seen through the citation table it returns."""
    done = jobs.index_sources(dealt(t["corpus"]), t["word_names"], t["word_references"], t["curated"])
    return done.references.groupBy("simulant_id").agg(F.count(F.lit(1)).alias("n"))
