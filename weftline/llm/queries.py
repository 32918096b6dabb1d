"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import garbled, lines, packing, reading, residue, seen, tokens
from weftline.session import materialise, spread, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "responses").select("response_id", "headers", "encoding", "body"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_responses(table(spark, sf_dir, "responses"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.main_content(table(spark, sf_dir, "responses"), table(spark, sf_dir, "cached_responses"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_responses(_bodies(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.repaired_responses(_bodies(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.seen_requests(table(spark, sf_dir, "requests"), table(spark, sf_dir, "seen_fingerprints"))


def p4_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = seen.error_report(table(spark, sf_dir, "requests"), table(spark, sf_dir, "seen_fingerprints"))
    return report.withColumn("derived_rate", F.round("derived_rate", 18))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.RepeatedLines(table(spark, sf_dir, "responses"), table(spark, sf_dir, "requests")).found()


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the lines of at least two different documents and two days, so that a republished article stays whole."""
    return lines.RepeatedLines(table(spark, sf_dir, "responses"), table(spark, sf_dir, "requests"), min_clusters=2, min_days=2).cleaned()


def p5_cleaned_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without all lines of p5_found, those of republished articles among them."""
    return lines.RepeatedLines(table(spark, sf_dir, "responses"), table(spark, sf_dir, "requests")).cleaned()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.Encoder(_texts(spark, sf_dir)).ids()


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode_ids(tokens.Encoder(_texts(spark, sf_dir)).ids())


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The window sizes: a fixed table of three rows."""
    return [tuple(r) for r in table(spark, sf_dir, "context_windows").select("window_id", "capacity").orderBy("window_id").collect()]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(tokens.token_counts(_texts(spark, sf_dir)), "sizes")
    return packing.pack(sizes, _capacities(spark, sf_dir))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir), _capacities(spark, sf_dir))


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window size the documents packed, and how many bins and documents break a rule of packing."""
    return packing.validity(_packed(spark, sf_dir), _capacities(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _texts(spark, sf_dir)
    return reading.hardest(documents, reading.fitted(documents, table(spark, sf_dir, "reading_labels")))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _texts(spark, sf_dir)
    return reading.levels(documents, reading.fitted(documents, table(spark, sf_dir, "reading_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_repaired, p4_found, p4_error_rate, p5_found, p5_cleaned, p5_cleaned_found, p6_ids, p6_decoded, p7_packing, p7_fill, p7_valid, p8_found, p8_levels)}

_FINGERPRINT = (
    """lower(coalesce(fingerprint, sha1('{"body":"' || coalesce(lower(hex(case when json_type(session_kwargs::json, '$.data') = 'VARCHAR' then session_kwargs::json->>'data'"""
    """ else coalesce((session_kwargs::json->'data')::varchar, (session_kwargs::json->'json')::varchar) end)), '') || '","method":"' || upper(coalesce(session_kwargs::json->>'method', 'GET'))"""
    """ || '","sid":"' || coalesce(sid, '') || '","url":"' || split_part(coalesce(url, ''), '#', 1) || '"}')))"""
)

_KEYS = f"""(select request_id, min(enqueue_no) as enqueue_no, arg_min(fp, enqueue_no) as fp from (select request_id, enqueue_no, {_FINGERPRINT} as fp from requests
    where request_id is not null and enqueue_no is not null) group by 1)"""
_EARLIER = "(select distinct lower(hex(fingerprint)) as fp from seen_fingerprints where fingerprint is not null)"

_MEDIA = "lower(trim(split_part(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value, ';', 1)))"
_SITE = r"nullif(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '')"
# lines are cut in the escaped form of the bytes, so that a line of other bytes than UTF-8 does no harm to the rest
_LINES = f"""(select response_id, site, cluster, day, n, line, regexp_replace(lower(trim(regexp_replace(line, '[ \t\r\f\u00a0]+', ' ', 'g'))), '[0-9]+', '0', 'g') as k
    from (select response_id, site, cluster, day, n, coalesce(try(decode(raw::blob)), raw) as line from (
        select d.response_id, coalesce({_SITE.format("q.url")}, {_SITE.format("d.url")}, '') as site, md5(d.body) as cluster, d.fetched_at::date as day,
        unnest(range(1, len(string_split(d.body::varchar, '\\x0A')) + 1)) as n, unnest(string_split(d.body::varchar, '\\x0A')) as raw
        from responses d left join (select request_id, any_value(url) as url from requests where request_id is not null group by 1) q using (request_id)
        where d.response_id is not null and d.body is not null and {_MEDIA.replace("headers", "d.headers")} = 'text/plain')))"""
_REPEATED = """(select site, k from (select l.site, l.k, count(distinct l.response_id) as responses, count(distinct l.cluster) as clusters, count(distinct coalesce(f.day, date '1900-01-01')) as days
    from {0} l join (select site, cluster, min(day) as day from {0} group by 1, 2) f on f.site = l.site and f.cluster = l.cluster where l.k <> '' group by 1, 2)
    where responses >= 4 and clusters >= {1} and days >= {1})"""


def _cleaned(least: int) -> str:
    return f"""select response_id, coalesce(string_agg(line, chr(10) order by n) filter (not gone), '') as text from (select l.*, r.k is not null as gone from {_LINES} l left join {_REPEATED.format(_LINES, least)} r
        on r.site = l.site and r.k = l.k) group by 1 union all select response_id, null from responses where response_id is not null and body is null and {_MEDIA} = 'text/plain'"""


#: The others need HTML trees, fitted models or a tokenizer, which SQL can't say; they are tested against brute force.
ORACLE_SQL = {
    "p4_found": f"""select request_id from (select request_id, enqueue_no, fp, min(enqueue_no) over (partition by fp) as first_no from {_KEYS})
        where enqueue_no > first_no or fp in (select fp from {_EARLIER})""",
    # a hash of 48 bits or more has no collision among so few keys: the measured rate is 0
    "p4_error_rate": f"""select asked_requests, stored_keys, new_requests, 0::bigint as wrong_answers, 0.0::double as measured_rate,
        round((stored_keys + new_requests / 2) * pow(2, -hash_bits), 18) as derived_rate, hash_bits from (
        select (select count(*) from {_KEYS}) as asked_requests, (select count(*) from {_EARLIER}) as stored_keys, (select count(distinct fp) from {_KEYS} where fp not in (select fp from {_EARLIER})) as new_requests,
        (48 + greatest(0, ceil(log2(((select count(*) from requests) + (select count(*) from seen_fingerprints)) / 65536.0))))::int as hash_bits)""",
    "p5_found": f"""select response_id, n::int as line_no from {_LINES} l where exists (select 1 from {_REPEATED.format(_LINES, 1)} r where r.site = l.site and r.k = l.k)""",
    "p5_cleaned": _cleaned(2),
    "p5_cleaned_found": _cleaned(1),
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents where doc_id is not null",
    "p7_valid": """select w.window_id, d.documents, 0::bigint as overfull_bins, 0::bigint as wrongly_split, 0::bigint as incomplete
        from context_windows w, (select count(*) as documents from documents where doc_id is not null) d where w.capacity > 0""",
}
