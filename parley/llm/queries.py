"""Queries of the training-data operators and, where SQL can express them, their DuckDB form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import conversation_trie, decontamination, html_extraction, near_dedup, packing, quality_classifier, quality_rules, secret_scan, sharding, suffix_dedup, suffix_tree_lm, token_alignment, warc_zip
from parley.llm.common import shared_folder

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_files() -> dict[str, str]:
    """The tokenizer that packing uses."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path(TOKENIZER)}


def aligned_files() -> dict[str, str]:
    """The two tokenizers that are aligned."""
    import public_tokenizers

    return {"a": public_tokenizers.path(TOKENIZER), "b": public_tokenizers.path(PIECES)}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_read(spark, sf_dir, "pages"))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, quality_classifier.grades(_read(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model).withColumn("kept", F.col("p_top") >= quality_classifier.LEAST)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), **tokenizer_files())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.train(pages))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sharding.shard_and_compact(_read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    return table.read().select("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.crc32("text").alias("text_crc32"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: token_alignment.digest(groups) if groups else ""
    return token_alignment.align(_read(spark, sf_dir, "documents"), **aligned_files(), show=digest).withColumnRenamed("groups", "groups_sha256")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_read(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), show=lambda kept: F.sha2(kept, 256))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


_OP2_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
lead as (select payload_digest, min(page_id) as lead from p where payload_bytes >= 100 group by all)
select page_id, payload_bytes, payload_digest, case when lead <> page_id then 'revisit' else 'response' end as record_type,
  case when lead <> page_id then lead end as refers_to
from p left join lead using (payload_digest)"""


def _op10_sql() -> str:
    rules = {k: f"coalesce(1000.0 * {a} / nullif({b}, 0), 0)" for k, (a, b) in quality_rules.RULES.items()}
    grid = ", ".join(f"{c}.0" for c in quality_rules.GRID)
    shares = " union all ".join(f"select stratum, '{k}' as rule, {e} as share from held" for k, e in rules.items())
    cuts = ", ".join(f"max(case when rule = '{k}' then cut end) as cut_{k}" for k in rules)
    risk = 0.02 / len(rules)
    failed = ", ".join(f"case when {e} > cut_{k} then '{k}' end" for k, e in rules.items())
    return f"""
with base as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
wins as (
  select doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] as w
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from base where len(words) >= 5)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from wins) where n > 1),
reps as (select doc_id, count(distinct i + j) as n from twice, range(0, 5) as t(j) group by doc_id),
feats as (
  select base.doc_id, stratum, len(words)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(reps.n, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper
  from base left join reps using (doc_id)),
good as (select doc_id from labels group by doc_id having min(quality) = 1),
held as (select feats.* from feats join good using (doc_id)),
shares as ({shares}),
tested as (
  select stratum, rule, cut, count(*) as n, count(*) filter (where share > cut) as k
  from shares, (select unnest([{grid}]) as cut) group by all),
tails as (
  select stratum, rule, cut, n, k, count(*) over () as tests,
    case when k > n * {risk} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) end as tail
  from tested),
cuts as (select stratum, {cuts} from (select stratum, rule, min(cut) as cut from tails where tail <= 0.05 / tests group by all) group by stratum),
judged as (
  select feats.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, concat_ws(',', {failed}) as failed_rules
  from feats left join cuts using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules = '' as kept, failed_rules from judged"""


#: h is CRC-32 by its definition, bit by bit; nodes are the distinct prefixes, and each adds to all prefixes of its own.
_OP12_SQL = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, sha256(length(role)::varchar || ':' || role || text)) as seq from t group by conv_id),
keyed as (
  select conv_id, seq, conv_id - conv_id % 100 as lead,
    xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end))) % 6 as h
  from own),
whole as (
  select k.conv_id, list_concat(coalesce(o.seq[1:k.h], []), k.seq[k.h + 1:len(k.seq)]) as seq from keyed k left join own o on o.conv_id = k.lead),
prefixes as (select conv_id, len(seq) as n, d, seq[1:d] as path from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from whole)),
nodes as (
  select path, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256
  from prefixes group by path),
kids as (select path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by all),
known as (select nodes.*, coalesce(n_children, 0) as n_children, case when depth > 0 then length(path[depth].text) else 0 end as size from nodes left join kids using (path)),
sums as (
  select path[1:d] as path, sum((n_convs - 1) * size)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves
  from (select *, unnest(range(0, depth + 1)) as d from known) group by all)
select a.conv_id, a.depth, b.conv_id as parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256
from known a join sums using (path) left join nodes b on a.depth > 0 and b.path = a.path[1:a.depth - 1]"""


#: Every string of 200 bytes, as 400 hexadecimal digits, cut from parts of 500 bytes.
_OP13_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
part as (select r, k, length(h) // 2 - 200 - k as last, h[2 * k + 1:2 * k + 1000] as p from (select r, h, unnest(range(0, length(h) // 2 - 199, 300)) as k from d)),
w as (select r, k + i as i, md5(p[2 * i + 1:2 * i + 400]) as s from (select r, k, p, unnest(range(0, least(300, last + 1))) as i from part)),
twice as (select s from w group by s having count(*) > 1),
hit as (select r, i, (i - lag(i) over (partition by r order by i) > 200)::int as gap from w semi join twice using (s)),
run as (select r, min(i) as a, max(i) + 200 as b from (select *, sum(coalesce(gap, 1)) over (partition by r order by i) as run from hit) group by r, run),
cut as (select *, lag(b, 1, 0) over (partition by r order by a) as before from run),
kept as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(d.h[2 * before + 1:2 * a], '' order by a) || any_value(d.h)[2 * max(b) + 1:] as rest from cut join d using (r) group by r)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256 from d left join kept using (r)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc": op2_warc,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES: dict[str, str] = {"op2_warc": _OP2_SQL, "op10_quality_rules": _op10_sql(), "op12_conversation_trie": _OP12_SQL, "op13_suffix_dedup": _OP13_SQL}
