"""The thin queries ``opN_<name>``: each applies one operator to its whole table and derives the stated columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.warc import new_folder, read_warc, write_warc

    write_warc(table(spark, sf_dir, "pages"), folder := new_folder(spark))
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.urlfilter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.interactions import audit_documents

    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.suffixes import repeats

    return repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_pii": op5_pii,
    "op6_html_extraction": op6_html_extraction,
    "op7_minhash": op7_minhash,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_url_filter": op10_url_filter,
    "op11_interactions": op11_interactions,
    "op12_importance": op12_importance,
    "op13_suffixes": op13_suffixes,
}

ORACLES: dict[str, str] = {
    "op7_minhash": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        sets as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
        shingle as (select doc_id, len(s) as n, unnest(s) as s from sets),
        pair as (select a.doc_id as u, b.doc_id as v, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        link as (select u, v from pair where 100 * k >= 85 * (n + m - k)),
        way as (select u, v from link union all select v, u from link),
        reach as (select doc_id as id, doc_id as other from documents union select r.id, way.v from reach r join way on way.u = r.other),
        least as (select id, min(other) as component_id from reach group by 1)
        select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least on id = doc_id""",
    "op9_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        h as (select payload_digest, payload_bytes, max(page_id) as holder from p where payload_bytes >= 1000 group by all)
        select p.page_id, p.payload_bytes, p.payload_digest,
               case when h.holder <> p.page_id then 'revisit' else 'response' end as record_type,
               case when h.holder <> p.page_id then h.holder end as refers_to
        from p left join h using (payload_digest, payload_bytes)""",
    "op11_interactions": r"""
        with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
        w as (select doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as least from d),
        mark as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
        f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                     [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails
              from w left join mark using (doc_id)),
        c as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f group by 1, 2),
        letter as (select unnest([1, 2, 3, 4, 5]) as l),
        orders as (select [a.l, b.l, c.l, d.l, e.l] as o from letter a, letter b, letter c, letter d, letter e
                   where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        place as (select o, unnest([1, 2, 3, 4, 5]) as step from orders),
        seen as (select part, o, step, n, good, toxic, fails[o[step]] as own,
                        len(list_filter(o[:step - 1], lambda i: fails[i])) > 0 as gone, len(list_filter(fails, lambda x: x)) as k from c, place),
        s as (select part, o, step, sum(n) filter (where not own and not gone) as kept, sum(n) filter (where own and not gone) as removed,
                     sum(n) filter (where own and gone) as redundant, sum(n) filter (where own and k = 1) as unique_fails,
                     sum(good) filter (where own and not gone) as good_lost, sum(toxic) filter (where own and not gone) as toxic_lost from seen group by all)
        select part, array_to_string(list_transform(o, lambda i: chr(64 + i)), '') as filter_order, cast(step as int) as step,
               cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
               cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
               cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(sum(coalesce(removed, 0)) over (partition by part, o[step]) as bigint) as shapley
        from s""",
    "op12_importance": r"""
        with recursive crc(i, c, k) as (
            select i, i, 0 from range(256) t(i)
            union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8),
        crctable as (select list(c order by i) as lookup from crc where k = 8),
        d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        dw as (select r, unnest(w) as w from d),
        bw as (select unnest(w) as w from b),
        vocabulary as (select w, hex(encode(w)) as h from (select w from dw union select w from bw)),
        hashed as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: cast('0x' || h[2 * i + 1:2 * i + 2] as bigint))),
                          lambda c, x: xor(c >> 8, lookup[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from vocabulary, crctable),
        s as (select bucket, count(*) as s from dw join hashed using (w) group by 1),
        t as (select bucket, count(*) as t from bw join hashed using (w) group by 1),
        g as (select bucket, cast(floor(1000 * ln((cast(coalesce(t, 0) + 1 as double) * ((select count(*) from dw) + 10000)) / (cast(s + 1 as double) * ((select count(*) from bw) + 10000)))) as bigint) as gain from s left join t using (bucket)),
        weighed as (select r, sum(gain) as weight from dw join hashed using (w) join g using (bucket) group by 1),
        scored as (select r, doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
                          coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('2024:' || coalesce(cast(doc_id as varchar), ''))[:8] as bigint) + 0.5) / cast(4294967296 as double)))) as bigint) as score
                   from d left join weighed using (r)),
        ranked as (select r, row_number() over (order by score desc, doc_id nulls last) as rank from scored where n_features >= 20)
        select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
               case when rank <= (select count(*) from ranked) * 10 // 100 then rank end as rank
        from scored left join ranked using (r)""",
}
