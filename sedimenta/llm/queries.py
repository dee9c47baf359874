"""The queries of this subpackage, ``opN_<name>(spark, sf_dir)``, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import exact_dedup, hamming, jaccard, langid, mixing, packing, quality, toxicity, urls
from sedimenta.llm.sampling import crc_mod, labelled_rows
from sedimenta.llm.shards import ShardStore
from sedimenta.sources.hfs import shared_dir, stage_table

#: Rows that a classifier is fitted on, at most (about).
FIT_ROWS = 20_000
QUALITY_ROWS = 10_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark, sf_dir):
    """The 10 nearest codes, by Hamming distance of sign bits, of every vector whose id is divisible by 100."""
    codes, _ = stage_table(hamming.sign_codes(_table(spark, sf_dir, "embeddings")), "codes")
    return hamming.top_k(codes.where("id % 100 = 0"), codes, k=10).withColumnRenamed("id", "vec_id")


def op2_language_id(spark, sf_dir):
    """The language of every document, learned where crc32(doc_id) mod 3 isn't 1."""
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out), FIT_ROWS)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_sharding(spark, sf_dir):
    """Where each document lies after 16 arrivals and their compaction."""
    docs = _table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", docs.schema, target_bytes=64 << 20)
    store.append(docs, arrivals=16, key="doc_id")
    store.compact()
    store.vacuum()
    return store.placed("doc_id")


CONTRACT_RULES = (
    urls.prefix_rule("com", "/", "allow"),
    urls.prefix_rule("example.com", "/en/", "block"),
    urls.prefix_rule("www.example.com", "/en/", "allow"),
    urls.prefix_rule("net", "/es/", "block"),
    urls.prefix_rule("net", "/fr/", "block"),
)


def op4_url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(_table(spark, sf_dir, "pages"), CONTRACT_RULES + urls.DEFAULT_RULES)


def op5_jaccard_join(spark, sf_dir):
    """Groups of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op6_exact_dedup(spark, sf_dir):
    """Which document stays of each group of equal texts."""
    return exact_dedup.decisions(_table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    """The words that the mix takes of each document."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def toxicity_model(spark, docs, sf_dir):
    labels = _table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.fit(labelled_rows(docs.select("doc_id", "text"), labels, "toxic", FIT_ROWS), FIT_ROWS)


def op9_toxicity(spark, sf_dir):
    """A toxicity score for every document, learned where crc32(doc_id) mod 5 isn't 0."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), "score", ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark, sf_dir):
    """A quality score for every document from two co-trained views, learned where crc32(doc_id) mod 5 isn't 0."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    table, _ = stage_table(quality.features(docs), "features")
    scored = quality.score(table, quality.fit(table, labels, "quality", QUALITY_ROWS))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_language_id, op3_sharding, op4_url_filters, op5_jaccard_join, op6_exact_dedup, op7_mixing, op8_packing, op9_toxicity, op10_quality)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_words = "|".join([*urls.HOST_WORDS, *("[-_.]".join(w) for w in urls.HOST_PAIRS)])
_paths = rf"/({'|'.join(urls.PATH_WORDS)})([^A-Za-z0-9]|$)|^[^/]*/([^?]*[^A-Za-z0-9])?({'|'.join('[-_./]'.join(w) for w in urls.PATH_RUNS)})([^A-Za-z0-9]|$)"

ORACLES = {
    "op1_exact_topk": """
        with met as (
            select q.vec_id as query_id, e.vec_id,
                   cast(list_sum(list_transform(range(1, (select max(len(embedding)) from embeddings) + 1), lambda i: case when coalesce(q.embedding[i] > 0, false) <> coalesce(e.embedding[i] > 0, false) then 1 else 0 end)) as integer) as distance
            from embeddings q, embeddings e where q.vec_id % 100 = 0 and q.embedding is not null and e.embedding is not null),
        ranked as (select *, cast(row_number() over (partition by query_id order by distance, vec_id) as integer) as rank from met)
        select query_id, rank, vec_id, distance from ranked where rank <= 10""",
    "op4_url_filters": rf"""
        with parts as (
            select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        hosts as (
            select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
            from parts),
        rules(rule_host, rule_path, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        fits as (
            select page_id, host, path, rule_host || rule_path as rule, v,
                   row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as n
            from hosts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
        select page_id, host, path, rule,
               coalesce(v, case when regexp_matches(host, '(^|[^a-z0-9])({_words})([^a-z0-9]|$)') or regexp_matches(host || path, '{_paths}') then 'block' else 'allow' end) as verdict
        from fits where n = 1""",
    "op5_jaccard_join": rf"""
        with recursive words as (select doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') as w from documents),
        sets as (
            select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
        flat as (select doc_id, len(s) as n, unnest(s) as x from sets),
        links as (
            select a.doc_id as a, b.doc_id as b from flat a join flat b on a.x = b.x and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join links l on r.b = l.a)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id
        from sets s join (select a, min(b) as component_id from reach group by a) r on r.a = s.doc_id""",
    "op6_exact_dedup": f"""
        with t as (select doc_id, {_FOLDED} as text from documents)
        select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
               doc_id = max(doc_id) over (partition by text) as kept, sha256(text) as text_sha256 from t""",
    "op7_mixing": r"""
        with sized as (
            select doc_id, source as src, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                   md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
        s1 as (select src, cast(sum(size) as bigint) as source_size, count(*) as docs, row_number() over (order by src asc nulls last) as place from sized group by src),
        s2 as (select *, case (place - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as total from s1),
        s3 as (
            select *, (total - (sum(cap) over f - cap)) / (sum(w) over () - sum(w) over f + w) as level from s2
            window f as (order by cap / w, place rows between unbounded preceding and current row)),
        s4 as (select *, (select level from s3 where cap / w > level order by cap / w, place limit 1) as free from s3),
        s5 as (select place, src, source_size, coalesce(least(cap, free * w), cap) as target, cast(ceil(docs / 8192.0) as bigint) as shards from s4),
        dealt as (
            select d.*, s.place, s.source_size, s.target, cast(('0x' || substr(d.key, 1, 8)) as bigint) % s.shards as shard
            from sized d join s5 s on d.src is not distinct from s.src),
        shard1 as (select place, shard, sum(size) as words, cast(ceil(sum(size) / 32.0) as bigint) as blocks from dealt group by place, shard),
        caps as (select place, cast(sum(blocks) * 2 as bigint) as most from shard1 group by place),
        seats1 as (select place, target, c.most, cast(round(sum(target) over () / 32) as bigint) as seats from s5 join caps c using (place)),
        won1 as (
            select place, k, seats, row_number() over (order by target / (2 * k + 1) desc, place, k) as r
            from (select place, target, seats, unnest(range(0, most)) as k from seats1) where target > 0),
        quota1 as (select s.place, count(w.k) as seats from seats1 s left join won1 w on w.place = s.place and w.r <= w.seats group by s.place),
        won2 as (
            select place, shard, k, seats, row_number() over (partition by place order by cast(words as double) / (2 * k + 1) desc, shard, k) as r
            from (select place, shard, words, seats, unnest(range(0, blocks * 2)) as k from shard1 join quota1 using (place)) where words > 0),
        quota2 as (
            select s.place, s.shard, s.blocks, count(w.k) as quota from shard1 s left join won2 w on w.place = s.place and w.shard = s.shard and w.r <= w.seats group by s.place, s.shard, s.blocks),
        firsts as (
            select q.*, cast(('0x' || substr(md5('mix:' || coalesce('s' || s.src, 'n') || ':' || q.shard), 1, 8)) as bigint) % greatest(q.blocks, 1) as first_block
            from quota2 q join s5 s using (place)),
        lying as (
            select d.*, sum(size) over (partition by place, shard order by key, doc_id, size rows between unbounded preceding and current row) - size as start from dealt d),
        cells as (
            select l.doc_id, l.size, l.start, f.quota, f.blocks, f.first_block, unnest(range(cast(floor(l.start / 32) as bigint), cast(floor((l.start + l.size - 1) / 32) as bigint) + 1)) as k
            from lying l join firsts f using (place, shard) where l.size > 0),
        extra as (
            select doc_id, sum(case when (k * 2147483647 + first_block) % blocks < quota % blocks then least(start + size, (k + 1) * 32) - greatest(start, k * 32) else 0 end) as x,
                   any_value(floor(quota / blocks)) as full_times from cells group by doc_id)
        select l.doc_id, l.size, l.source_size, l.target, cast(coalesce(e.full_times * l.size + e.x, 0) as bigint) as taken
        from lying l left join extra e using (doc_id)""",
}
