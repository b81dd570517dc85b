"""One query for each operator, over its whole table; ORACLES has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import chat, embeddings, jaccard, langid, licenses, media, mixing, negatives, packing, quality, sharding, spelling, warc
from lodestrata.llm.common import bound_batches, materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return run(spark, sf_dir)

        QUERIES[name] = bounded
        if sql:
            ORACLES[name] = sql
        return run

    return add


OK = "</s>[INST] ok [/INST]"

_ESCAPED = r"""regexp_replace(regexp_replace(coalesce({0}, ''), '<(\\*)(\||/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"""


@_query(
    "op1_chat_format",
    f"""
    with t as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-1, 0, 'user', '{OK}'), (-1, 1, 'assistant', '{OK}')),
    e as (
      select *, {_ESCAPED.format("role")} as er, {_ESCAPED.format("text")} as et,
        lag(role) over (partition by conv_id order by turn nulls last, role, text) as before
      from t)
    select conv_id, cast(count(*) as bigint) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
      cast(sum(length(et) + case when before is null or before <> role then length(er) + 23 else 8 end) as bigint) as formatted_chars
    from e group by conv_id""",
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))]))
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), tricky.alias("t")).select("conv_id", "t.turn", "t.role", F.lit(OK).alias("text"))
    return chat.digest(chat.read_back(chat.format_chat(turns.unionByName(own))))


@_query(
    "op2_embedding_dedup",
    """
    with recursive v as (
      select vec_id, embedding::double[] as e from embeddings
      where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.95),
    r as (select vec_id, vec_id as c from embeddings union select r.vec_id, l.b from r join l on l.a = r.c),
    k as (select vec_id, min(c) as component_id from r group by vec_id),
    n as (select a, count(*) as n from l group by a)
    select k.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, k.component_id, k.vec_id = k.component_id as kept
    from k left join n on n.a = k.vec_id""",
)
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@_query("op4_media_columns")
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = media.store(table(spark, sf_dir, "documents"))
    return media.describe(media.load(spark, manifest))


#: crc32 byte by byte; its 256 remainders follow from the polynomial.
_REMAINDERS = """(select list(r order by i) as remainders from (
      select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as r
      from range(256) as b(i)))"""


def _draw(path: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(h || '/{path}'), 1, 12))::bigint + 0.5::double) / 281474976710656::double) / {weight}::double"


def _below(region: int) -> str:
    """The shard of a key that has come to a region of four shards in two racks."""
    racks = [2 * region, 2 * region + 1]
    shard = {k: f"case when {_draw(f'region{region}.rack{k}.shard{2 * k}', 1)} <= {_draw(f'region{region}.rack{k}.shard{2 * k + 1}', 1)} then {2 * k} else {2 * k + 1} end" for k in racks}
    return f"case when {_draw(f'region{region}.rack{racks[0]}', 2)} <= {_draw(f'region{region}.rack{racks[1]}', 2)} then {shard[racks[0]]} else {shard[racks[1]]} end"


@_query(
    "op5_shard_tree",
    f"""
    with t as {_REMAINDERS},
    d as (select doc_id, text, md5(coalesce(cast(doc_id as varchar), 'null')) as h from documents),
    r as (select *, {_draw("region0", 4)} as d0, {_draw("region1", 4)} as d1, {_draw("region2", 1)} as d2, {_below(0)} as s0, {_below(1)} as s1 from d),
    b as (select *, case when d0 <= d1 then s0 else s1 end as shard, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from r),
    c as (select doc_id, h, shard, case when d2 < least(d0, d1) then 8 else shard end as grown_shard, len(bytes) + 1 as size,
      xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, remainders[1 + (xor(c, x) & 255)]))) as text_crc32 from b, t)
    select doc_id, size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard, (row_number() over (partition by shard order by h, doc_id, size, text_crc32)) - 1 as slot, grown_shard::int as grown_shard from c""",
)
def op5_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


#: SHA-1 in base32: 40 hex digits are 160 bits, which are read in fives.
_BASE32 = """(select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (('0x' || substr(sha1(h) || '0', 1 + (i * 5) // 4, 2))::int >> (3 - (i * 5) % 4)) % 32, 1), '' order by i)
      from range(32) as r(i)) as payload_digest"""


@_query(
    "op6_warc_records",
    """
    with p as (select page_id, coalesce(html, '') as h from pages),
    t as (select h, max(page_id) as top from p group by h)
    select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(h) as sha1_hex,
      case when page_id = top then 'response' else 'revisit' end as record_type,
      case when page_id <> top then top end as refers_to
    from p join t using (h)""".replace("sha1(h) as sha1_hex", _BASE32),
)
def op6_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.load(warc.store(table(spark, sf_dir, "pages")))


_SIZE = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"


@_query(
    "op7_mix_sources",
    f"""
    with d as (select doc_id, source, coalesce({_SIZE}, 0) as size, md5(coalesce(cast(doc_id as varchar), 'null')) as h from documents),
    s as (select source, sum(size)::double as source_size from d group by source),
    w as (select *, [5.0::double, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight, 3 * source_size as cap from s),
    l as (select *, cap / weight as ratio,
        (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
    t as (select source, source_size, least(cap, (max(case when level <= ratio then level end) over ()) * weight) as target from l),
    q as (select d.*, t.source_size, t.target,
        (sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and current row))::double as upto
        from d join t on d.source is not distinct from t.source),
    c as (select *, (upto + e * source_size) / target as finish from q, (values (0), (1), (2)) as x(e) where size > 0 and target > 0),
    f as (select *, sum(size) over (order by finish, source nulls last, h, doc_id, size, e rows between unbounded preceding and current row) as served from c),
    k as (select source, h, doc_id, size, upto, count(*) as n from f where served <= (select sum(size) from d) group by all)
    select q.doc_id, cast(q.size as bigint) as size, cast(q.source_size as bigint) as source_size, q.target,
      cast(q.size * coalesce(k.n, 0) as bigint) as taken
    from q left join k on q.source is not distinct from k.source and q.h = k.h and q.doc_id is not distinct from k.doc_id and q.size = k.size and q.upto = k.upto""",
)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(spark, mixing.word_sizes(table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))


@_query(
    "op9_jaccard_join",
    r"""
    with recursive w as (
      select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
      from documents where text is not null),
    s as (select distinct doc_id, array_to_string(ws[i : i + 3], ' ') as shingle
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
    l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= 85 * (x.n + y.n - k)),
    r as (select doc_id, doc_id as c from documents union select r.doc_id, l.b from r join l on l.a = r.c)
    select r.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(c) as component_id
    from r left join n on n.doc_id = r.doc_id group by r.doc_id""",
)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op10_pack_sequences")
def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, p = langid.train(docs)
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identify(rows, langs, p).drop("text")


@_query("op8_quality_score")
def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", quality.held_out().alias("held_out"), "text")
    scored = quality.score(rows, weights).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@_query(
    "op12_spelling_variants",
    rf"""
    with recursive t as {_REMAINDERS},
    o as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
    c as (select doc_id, run, count(*) as k from o group by all),
    b as (select run, k, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''),
        lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195, unicode(ch)::bigint - 64] end)) as bytes from c),
    h as (select run, k, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, remainders[1 + (xor(c, x) & 255)]))) as h from b, t),
    w as (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, (h % length(run))::bigint + 2) else run end as word, sum(k) as n
      from h group by 1 having sum(k) >= 3),
    v as (select word, n::bigint as n, length(word) as len from w where length(word) >= 5),
    d as (select word, n, len, i, left(word, i - 1) || substr(word, i + 1) as rest from v, lateral (select unnest(range(1, len + 1)) as i)),
    s as (select distinct word, n, rest from d),
    p as (select a.word, b.word as other, b.n as other_n from d a join d b on a.len = b.len and a.i = b.i and a.rest = b.rest and a.word <> b.word
      union all select s.word, v.word, v.n from s join v on s.rest = v.word
      union all select v.word, s.word, s.n from s join v on s.rest = v.word),
    q as (select word, count(*) as n_near, max(other_n) as top from p group by word),
    f as (select p.word, min(other) as form, top from p join q using (word) where other_n = top group by all),
    g as (select v.word, v.n, coalesce(q.n_near, 0) as n_near, case when f.top >= 2 * v.n then f.form end as form, case when f.top >= 2 * v.n then f.top end as form_n
      from v left join q using (word) left join f using (word)),
    r as (select word, word as root, form as further from g union all select r.word, g.word, g.form from r join g on g.word = r.further)
    select g.word, g.form, r.root, g.n, cast(g.n_near as bigint) as n_near, g.form_n from g join r on r.word = g.word and r.further is null""",
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@_query("op13_license_scan")
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@_query(
    "op11_hard_negatives",
    """
    with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding::double[], lambda x: floor(256 * x)) as x
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
    s as (select a.vec_id as anchor, a.label as own, b.vec_id as other, b.label, list_dot_product(a.x, b.x)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 100 = 0),
    p as (select anchor, other, score from s where own = label qualify row_number() over (partition by anchor order by score desc, other) <= 5),
    n as (select p.anchor as anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor, p.other order by s.score desc, s.other) as rank
      from p join s on s.anchor = p.anchor and s.own <> s.label and 80 * p.score <= 100 * s.score and s.score <= p.score)
    select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))
