"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogue, exact_dedup, lm_scoring, merkle, mixing, near_dedup, packing, quality, sharding, substring_dedup, topk_search, toxicity, url_filter

RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def tokenizer_paths() -> dict[str, str]:
    import public_tokenizers

    return {
        "json_path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_paths())


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.rows_named(topk_search.integral(table(spark, sf_dir, "embeddings")))
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), row_col="row")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.audit(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_url_filters": op7_url_filters,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_sharding": op9_sharding,
        "op10_mixing": op10_mixing,
        "op11_toxicity": op11_toxicity,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_conversation_repair": op13_conversation_repair,
    }


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "xor(c >> 1, case when c & 1 = 1 then 3988292384::bigint else 0::bigint end)"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: {byte}))"


ORACLES = {
    "op3_exact_dedup": """
        with d as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
        )
        select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from d
    """,
    "op7_url_filters": r"""
        with a as (
            select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
        ), p as (
            select page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from a
        ), r(rule, rule_host, rule_path, verdict) as (
            values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), f as (
            select page_id, host, path, r.rule, r.verdict,
                   row_number() over (partition by page_id order by length(r.rule) desc) as n
            from p left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        )
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where n = 1
    """,
    "op12_merkle_manifest": f"""
        with recursive d as (
            select coalesce('=' || lang, '') as tree, doc_id, n_chars, coalesce({crc32_sql("doc_id::varchar")} % 7 = 0, false) as hit,
                   [doc_id::varchar, source, lang] as head, text
            from documents
        ), told as (
            select tree, doc_id, hit and n_chars is not null as hit,
                   list_reduce(list_prepend('', list_transform(head, lambda x: coalesce(strlen(x) || ':' || x, '-'))), lambda x, y: x || y) as head,
                   n_chars, coalesce(strlen(text) || ':' || text, '-') as tail
            from d
        ), leaves as (
            select tree, doc_id, hit, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
                   sha256(head || coalesce(strlen((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1), '-') || tail) as other
            from told
        ), placed as (
            select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from leaves
        ), nodes(tree, level, idx, h) as (
            select tree, 0, place, leaf from placed
            union all
            select tree, level + 1, idx // 2, sha256(string_agg(h, '' order by idx))
            from (select *, count(*) over (partition by tree) as n from nodes) where n > 1 group by tree, level, idx // 2
        ), subroots as (
            select tree, arg_max(h, level) as subroot, max(level) as height, row_number() over (order by tree) - 1 as g from nodes group by tree
        ), tops(level, idx, h) as (
            select 0, g, subroot from subroots
            union all
            select level + 1, idx // 2, sha256(string_agg(h, '' order by idx))
            from (select *, count(*) over () as n from tops) where n > 1 group by level, idx // 2
        ), steps as (
            select p.tree, p.place, level::bigint as level, p.place >> level::bigint as pos from placed p join subroots s using (tree), generate_series(0, 62) t(level) where level < height
        ), up as (
            select g, level::bigint as level, g >> level::bigint as pos from subroots, generate_series(0, 62) t(level) where level < (select max(level) from tops)
        ), inner_way as (
            select s.tree, s.place, list(case when n.h is null then '-' when pos & 1 = 1 then 'L' || n.h else 'R' || n.h end order by s.level) as way
            from steps s left join nodes n on n.tree = s.tree and n.level = s.level and n.idx = xor(s.pos, 1) group by s.tree, s.place
        ), outer_way as (
            select u.g, list(case when n.h is null then '-' when pos & 1 = 1 then 'L' || n.h else 'R' || n.h end order by u.level) as way
            from up u left join tops n on n.level = u.level and n.idx = xor(u.pos, 1) group by u.g
        ), told_ways as (
            select p.*, s.subroot, list_concat(coalesce(i.way, []), coalesce(o.way, [])) as way, (select h from tops order by level desc limit 1) as root
            from placed p join subroots s using (tree) left join inner_way i on i.tree = p.tree and i.place = p.place left join outer_way o on o.g = s.g
        ), folded as (
            select *, list_reduce(list_prepend(case when hit then other else leaf end, way),
                        lambda a, s: sha256(case s[1] when 'L' then substr(s, 2) || a when 'R' then a || substr(s, 2) else a end)) as folded_root
            from told_ways
        )
        select doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(way, lambda s: substr(s, 2))), lambda a, b: a || b)) as proof_sha256,
               folded_root, folded_root = root as verified, place, (case when hit then len(way) + 1 else 0 end)::int as copied_nodes
        from folded
    """,
    "op13_conversation_repair": f"""
        with recursive k as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
            from conversations
        ), damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                   case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
            from k where kind <> 0
        ), placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
                   row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said
            from damaged
        ), faults as (
            select conv_id, turn, role, text, n, substr(role, 1, 1) as i, said = '' as blank, said <> '' and seen > 1 as duplicate,
                   said <> '' and seen = 1 and right(said, 1) not in ('.', '!', '?') as truncated,
                   lag(substr(role, 1, 1)) over (partition by conv_id order by n) as before
            from placed
        ), counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank, sum(duplicate::int) as duplicate,
                   sum(truncated::int) as truncated, sum((before is not null and before || i not in ('su', 'ua', 'au'))::int) as illegal, max(n) as rows
            from faults group by conv_id
        ), ways(source, mid, pre, said, pay) as (
            values (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0), (0, 2, 'I', chr(10) || 'user:', 3), (1, 2, 'I', chr(10) || 'user:', 3),
                   (2, 3, 'I', chr(10) || 'assistant:', 3), (3, 2, 'I', chr(10) || 'user:', 3), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6),
                   (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6)
        ), moves(mid, edit, i, goes, pay) as (
            values (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (0, 'R', null, 2, 3), (1, 'R', null, 2, 3),
                   (3, 'R', null, 2, 3), (2, 'R', null, 3, 3), (0, 'D', null, 0, 4), (1, 'D', null, 1, 4), (2, 'D', null, 2, 4), (3, 'D', null, 3, 4)
        ), search(conv_id, n, state, best) as (
            select conv_id, 0::bigint, 0, {{'cost': 0::bigint, 'audit': '', 'told': ''}} from counts
            union all
            select s.conv_id, f.n, m.goes,
                   min({{'cost': s.best.cost + w.pay + m.pay + case when f.truncated and m.edit <> 'D' then 3 else 0 end, 'audit': s.best.audit || w.pre || m.edit,
                        'told': s.best.told || w.said || case m.edit when 'K' then chr(10) || f.role || ':' || f.text
                            when 'R' then chr(10) || (case m.goes when 2 then 'user' else 'assistant' end) || ':' || f.text else '' end}})
            from search s join faults f on f.conv_id is not distinct from s.conv_id and f.n = s.n + 1 join ways w on w.source = s.state
                 join moves m on m.mid = w.mid and (m.i is null or m.i = f.i) and (m.edit = 'D' or not (f.blank or f.duplicate))
            group by s.conv_id, f.n, m.goes
        ), ends as (
            select s.conv_id, min({{'cost': s.best.cost + w.pay, 'audit': s.best.audit || w.pre, 'told': s.best.told || w.said}}) as best
            from search s join counts c on c.conv_id is not distinct from s.conv_id and c.rows = s.n join ways w on w.source = s.state where w.mid in (0, 3) group by s.conv_id
        )
        select o.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate,
               coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal, coalesce(e.best.cost, 0)::bigint as cost,
               coalesce(e.best.audit, '') as audit, sha256(coalesce(substr(e.best.told, 2), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
             left join ends e on e.conv_id is not distinct from o.conv_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
