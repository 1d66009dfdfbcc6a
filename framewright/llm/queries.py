"""The ``opN_`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_format, read_loss, read_turns, records_of
from .decontaminate import decontaminate
from .itemsets import frequent_itemsets
from .mixing import mix_sources
from .pii import KINDS as PII_KINDS
from .pii import personal_data
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .resampling import importance_resample
from .secrets import KINDS as SECRET_KINDS
from .secrets import secret_scan
from .sharding import rendezvous_shards
from .simhash import simhash_near_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import TOP, V, difference_set, suffix_array_dedup


#: Both texts of the conversation that operator 12 adds.
TRICKY = r"\### Assistant: </turn> ok"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def covered(spans: str) -> Column:
    """Cells in an array of disjoint (start, end) ranges."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def digest(kinds: tuple[str, ...]) -> list[Column]:
    """The digest of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return [F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(documents(spark, sf_dir), length=400)
    return out.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_partners")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), width=13)
    return out.select("doc_id", "n_words", covered("spans").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(documents(spark, sf_dir))
    return out.select("doc_id", *map(counted, SECRET_KINDS), *digest(SECRET_KINDS), F.size("spans").cast("long").alias("n_spans"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), share=1.5, weights=(3, 1, 2), cap=2.0).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "copies")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(documents(spark, sf_dir))
    return out.select("doc_id", *map(counted, PII_KINDS), *digest(PII_KINDS), F.size("spans").cast("long").alias("n_spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rendezvous_shards(documents(spark, sf_dir), weights=(1.0,) * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(documents(spark, sf_dir), width=4, radius=4)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), longest=1, buckets=10_000, percent=10, least_words=20, seed="2024")
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "role", "text")
    tricky = F.lit(TRICKY)
    messages = F.array(*[F.struct(F.lit(role).alias("role"), tricky.alias("content")) for role in ("user", "assistant")])
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
    out = chat_format(rows.unionByName(more))
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op13_frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").filter(~F.col("flag").eqNullSafe("returned"))
    out = frequent_itemsets(lines, "sale_id", "item_id", least=8, per=2000, percent=10)
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["item"].alias("item"))))
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["item"], r["a"], r["s"])), ";")
    return out.select(F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"), best["item"].alias("best_item"), F.sha2(text.cast("binary"), 256).alias("rules_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_personal_data": op5_personal_data,
    "op6_quality_rules": op6_quality_rules,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_importance_resample": op11_importance_resample,
    "op12_chat_format": op12_chat_format,
    "op13_frequent_itemsets": op13_frequent_itemsets,
}

#: Eight steps of the checksum's table, for the number i.
_CRC_STEPS = "i::bigint"
for _ in range(8):
    _CRC_STEPS = f"list_transform([{_CRC_STEPS}], lambda v: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)[1]"

#: SQL of the operators that SQL can express; the others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": rf"""
with d as (select doc_id, encode(coalesce(text, '')) b from documents),
 n as (select *, octet_length(b)::bigint n from d),
 p as (select doc_id, b, unnest(range(n - 399)) p from n where n >= 400),
 w as (select doc_id, p, md5(array_slice(b, p + 1, p + 400)) k from p),
 c as (select doc_id, p from w join (select k from w group by k having count(*) > 1) using (k)),
 o as (select *, lag(p) over (partition by doc_id order by p) before, lead(p) over (partition by doc_id order by p) after from c),
 r as (select doc_id, sum(least(400, coalesce(after - p, 400)))::bigint n_removed, count(*) filter (before is null or p > before + 400) n_spans from o group by doc_id),
 e as (select doc_id, p + 400 low, after high from o where after is null or after > p + 400 union all select doc_id, 0, p from o where before is null),
 g as (select doc_id, string_agg(hex(array_slice(b, low + 1, coalesce(high, n))), '' order by low) kept from e join n using (doc_id) group by doc_id),
 a as (select doc_id, b, n, unnest(range(n - {TOP - 1})) p from n where n >= 400),
 t as (select doc_id, md5(array_slice(b, p + 1, p + {TOP})) k from a where p % {V} in {difference_set()}),
 s as (select doc_id, count(*) n_partners from t join (select k from t group by k having count(*) > 1) using (k) group by doc_id)
select doc_id, n n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(case when kept is null then b else unhex(kept) end) kept_sha256, coalesce(n_partners, 0)::bigint n_partners
from n left join r using (doc_id) left join g using (doc_id) left join s using (doc_id)""",
    "op2_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 p as (select doc_id, unnest(range(len(w) - 12)) pos, w from d where len(w) >= 13),
 k as (select doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 13], ' ')) k from p),
 f as (select k, min(doc_id) least from k group by k),
 c as (select distinct doc_id, pos + unnest(range(13)) pos from k join f using (k) where doc_id > least),
 l as (select doc_id, unnest(w) word, unnest(range(len(w))) pos from d),
 r as (select doc_id, count(*) filter (c.pos is not null) n_removed, string_agg(word, ' ' order by pos) filter (c.pos is null) kept from l left join c using (doc_id, pos) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join r using (doc_id)""",
    "op4_mix_sources": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, (('0x' || left(md5('mix:' || doc_id), 8))::bigint >> 2) place from documents),
 s as (select source, sum(size)::double total, row_number() over (order by source nulls last) - 1 n from d group by source),
 w as (select *, [3.0, 1.0, 2.0][(n % 3 + 1)::int]::double weight, 2 * total most from s),
 l as (select *, (sum(total) over () * 1.5 - coalesce(sum(most) over (order by most / weight, n rows between unbounded preceding and 1 preceding), 0))
   / sum(weight) over (order by most / weight, n rows between current row and unbounded following) level from w),
 u as (select arg_min(level, most / weight) level from l where most > level * weight),
 t as (select source, total, least(most, coalesce(u.level * weight, most)) target from l left join u on true),
 b as (select *, case when total > 0 then floor(target / total) else 0 end base from t),
 c as (select d.*, total, target, base, target - base * total budget, sum(size) over (partition by d.source order by place) upto, sum(size) over (partition by d.source, place) n
   from d join b on d.source is not distinct from b.source),
 x as (select *, least(base + case when upto <= budget or upto - n <= budget and (budget - (upto - n)) * 2 >= n then 1 else 0 end, 2)::int copies from c)
select doc_id, size, total::bigint source_size, round(target, 6) target, size * copies taken, source, copies from x""",
    "op7_rendezvous_shards": rf"""
with t as (select list_transform(range(256), lambda i: {_CRC_STEPS}) crc_table),
 d as (select doc_id, encode(coalesce(text, '')) b, coalesce(doc_id::varchar, 'null') key from documents),
 c as (select d.*, octet_length(b)::bigint + 8 size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::bigint)),
   lambda c, x: xor(c >> 8, crc_table[xor(c & 255, x) + 1]))) text_crc32 from d, t),
 s as (select key, s shard, ('0x' || left(md5(key || ':' || s), 13))::bigint u from (select distinct key from d), range(25) r(s)),
 w as (select key, max((u, shard)) filter (shard < 24) w, max((u, shard)) g from s group by key),
 p as (select c.*, w[2]::int shard, g[2]::int grown_shard, ('0x' || left(md5('slot:' || key || ':' || text_crc32), 8))::bigint % 1024 chunk from c join w using (key))
select doc_id, size, text_crc32, 'key' as law, shard, (row_number() over (partition by shard order by chunk, doc_id nulls last, text_crc32, size) - 1)::bigint slot, grown_shard from p""",
    "op11_importance_resample": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
 b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) word from benchmark),
 f as (select doc_id, unnest(w) word from d),
 v as (select word, count(*) filter (mine) s, count(*) filter (not mine) t from (select word, true mine from f union all select word, false from b) group by word),
 t as (select list_transform(range(256), lambda i: {steps}) crc_table),
 h as (select word, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::bigint)),
   lambda c, x: xor(c >> 8, crc_table[xor(c & 255, x) + 1]))) % 10000 bucket from v, t),
 g as (select bucket, floor(1000 * ln((sum(t) + 1)::double * (sum(sum(s)) over () + 10000) / ((sum(s) + 1)::double * (sum(sum(t)) over () + 10000))))::bigint gain from h group by bucket),
 k as (select word, gain from h join g using (bucket)),
 w as (select d.doc_id, len(d.w)::bigint n, coalesce((select sum(gain) from unnest(d.w) u(word) join k using (word)), 0)::bigint gained from d),
 s as (select doc_id, n, case when n = 0 then 0 else (gained - ((gained % n) + n) % n) // n end weight from w),
 x as (select *, weight + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 8))::bigint + 0.5::double) / 4294967296)))::bigint score from s),
 r as (select *, case when n >= 20 then row_number() over (partition by n >= 20 order by score desc, doc_id nulls last) end place, count(*) filter (n >= 20) over () all_ from x)
select doc_id, n n_features, weight::bigint weight, score::bigint score, case when place <= 10 * all_ // 100 then place end::bigint as rank from r""".replace("{steps}", _CRC_STEPS),
    "op12_chat_format": r"""
with c as (select conv_id, turn, 0 place, coalesce(role, '') role, coalesce(text, '') body from conversations
   union all select -7, 0, p, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(p, r)),
 e as (select *, regexp_replace(role, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g') er, regexp_replace(body, '<(\\*)(turn>|text>|/turn>)', '<\\\1\2', 'g') eb from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn nulls first, place, er, eb)) turns_sha256,
 coalesce(sum(length(body)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(body, '' order by turn nulls first, place, er, eb) filter (role = 'assistant'), '')) loss_sha256,
 sum(length('<turn><text></turn>') + 1 + length(er) + length(eb))::bigint formatted_chars
from e group by conv_id""",
    "op13_frequent_itemsets": r"""
with recursive l as (select distinct sale_id, item_id from sale_lines where flag is distinct from 'returned' and sale_id is not null and item_id is not null),
 n as (select count(distinct sale_id)::bigint b from l),
 i as (select item_id, count(*)::bigint s, list(sale_id order by sale_id) t from l group by item_id having count(*) >= 8 and count(*) * 2000 >= (select b from n)),
 f as (select [item_id] items, item_id last, s, t from i
   union all select items || [item_id], item_id, len(t)::bigint, t from (select f.items, i.item_id, list_intersect(f.t, i.t) t from f join i on i.item_id > f.last), n where len(t) >= 8 and len(t) * 2000 >= b),
 u as (select items, s, c, list_filter(items, lambda x: x <> c) rest from (select items, s, unnest(items) c from f) where len(items) > 1),
 z as (select items, s from f where (items, s) not in (select rest, s from u)),
 r as (select u.items, u.c, a.s a, i.s sc from u join z on z.items = u.items join f a on a.items = u.rest join i on i.item_id = u.c, n where 100 * u.s >= 10 * a.s and u.s * n.b > a.s * i.s)
select array_to_string(z.items, ',') items, len(z.items)::bigint n_items, any_value(z.s)::bigint support, count(c)::bigint n_rules, arg_min(c, (a, c)) best_item, sha256(coalesce(string_agg(c || ':' || a || ':' || sc, ';' order by c), '')) rules_sha256
from z left join r on r.items = z.items group by z.items""",
}
