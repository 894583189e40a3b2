"""The registered queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import (
    centroids,
    contamination,
    licenses,
    line_dedup,
    packing,
    passages,
    phrases,
    quality,
    sharding,
    simhash,
    token_store,
    toolcalls,
    topk,
)
from weirlog.session import configure, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = call
    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_license_diagonals(spark, sf_dir):
    return licenses.summary(*licenses.scan(table(spark, sf_dir, "documents")))


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file, the same on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 20},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
            "within": {"type": "object"},
        },
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "translate": {
        "type": "object",
        "properties": {"text": {"type": "string"}, "to": {"enum": ["en", "fr", "de", "es"]}, "within": {}},
        "required": ["text", "to"],
    },
}


def tool_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results made of ``conversations``: an assistant calls, the turn after answers.

    The arguments are the texts. Some calls refer to the turn two before, in
    some conversations to the one two behind; some arguments break the schema
    and some tools do not exist.
    """
    turns = table(spark, sf_dir, "conversations")
    identifier = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    turn = F.col("turn")
    behind = F.pmod("conv_id", F.lit(7)) == 3
    refers = F.pmod(turn, F.lit(4)) == F.when(behind, 1).otherwise(3)
    other = F.struct(identifier(turn + F.when(behind, 2).otherwise(-2)).alias("$ref"))
    within = F.when(refers, other)
    search = F.to_json(
        F.struct(F.col("text").alias("query"), F.pmod("conv_id", F.lit(60)).alias("limit"), within.alias("within"))
    )
    to = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "it"))), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    translate = F.to_json(F.struct(to.alias("to"), within.alias("within"), F.col("text")))
    odd = F.pmod(F.col("conv_id") + turn, F.lit(5))
    calls = turns.where("role = 'assistant'").select(
        "conv_id",
        identifier(turn).alias("call_id"),
        "turn",
        F.when(odd < 2, "search").when(odd < 4, "translate").otherwise("lookup").alias("name"),
        F.when(odd < 2, search).otherwise(translate).alias("arguments"),
    )
    results = turns.where("role = 'user'").select(
        "conv_id", identifier(turn - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


@query
def op1_tool_calls(spark, sf_dir):
    return toolcalls.link_calls(*tool_messages(spark, sf_dir), SCHEMAS)


@query
def op2_contained_items(spark, sf_dir):
    found = contamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("version")


ORACLES["op2_contained_items"] = r"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
words as (
  select kind, id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
shingles as (
  select distinct kind, id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as s from words),
sizes as (select id as item_id, count(*) as n from shingles where kind = 'b' group by 1),
shared as (
  select d.id as doc_id, b.id as item_id, count(*) as m
  from shingles d join shingles b on d.s = b.s and d.kind = 'd' and b.kind = 'b' group by 1, 2)
select doc_id, item_id, n as shingles, m as shared, round(m / n, 6) as containment
from shared join sizes using (item_id) where m >= 0.8 * n
"""


@query
def op3_simhash_neighbours(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op5_token_store(spark, sf_dir):
    folder = new_folder(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    rows = token_store.read_tokens(spark, folder)
    return rows.select("doc_id", "start", "n_tokens", token_store.ids_crc32(F.col("ids")).alias("ids_crc32"))


@query
def op6_histogram_shards(spark, sf_dir):
    rows = sharding.shards(table(spark, sf_dir, "documents"), 40)
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(50)) == 0)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


@query
def op8_kneser_ney_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir)).drop("version")


@query
def op9_line_dedup(spark, sf_dir):
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_cut")


ORACLES["op9_line_dedup"] = r"""
with cut as (
  select doc_id, unnest(u) as unit, unnest(range(len(u))) as i from (
    select doc_id, regexp_extract_all(text, '[^\n]*?[.!?] |[^\n]*\n|[^\n]+') as u from documents)),
filled as (
  select doc_id, i, trim(unit, E' \t\r\n') as t, row_number() over (partition by doc_id order by i) as k
  from cut where trim(unit, E' \t\r\n') <> ''),
windows as (
  select doc_id, k, t, lead(t) over w as t2, lead(t, 2) over w as t3 from filled window w as (partition by doc_id order by k)),
repeated as (
  select doc_id, k, row_number() over (partition by t, t2, t3 order by doc_id, k) as place
  from windows where t3 is not null and length(t) + length(t2) + length(t3) >= 50),
gone as (
  select distinct doc_id, k + d as k from repeated, (select unnest([0, 1, 2]) as d) where place > 1),
spans as (
  select f.doc_id, f.i, f.k, g.k is not null as gone from filled f left join gone g on f.doc_id = g.doc_id and f.k = g.k),
edges as (
  select doc_id, i, gone, lag(gone) over (partition by doc_id order by k) as was from spans),
-- a blank unit goes where the units on both sides of it go
state as (
  select c.doc_id, c.i, c.unit,
    case when s.k is not null then s.gone
      else (select e.gone from spans e where e.doc_id = c.doc_id and e.i < c.i order by e.i desc limit 1)
       and (select e.gone from spans e where e.doc_id = c.doc_id and e.i > c.i order by e.i limit 1) end as gone
  from cut c left join spans s on c.doc_id = s.doc_id and c.i = s.i)
select d.doc_id, coalesce(a.text, '') as text, coalesce(b.n, 0) as n_cut
from documents d
left join (select doc_id, string_agg(unit, '' order by i) as text from state where gone is null or not gone group by 1) a using (doc_id)
left join (select doc_id, count(*) as n from gone group by 1) b using (doc_id)
"""


@query
def op10_best_fit_bins(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("version", "copy")


@query
def op11_repeated_passages(spark, sf_dir):
    rows = passages.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_repeated_passages"] = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, unnest(range(1, len(w) - 11)) as i, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) as s
  from words),
firsts as (select s, min(doc_id) as first_id from windows group by 1),
gone as (
  select distinct doc_id, i + d as i
  from windows join firsts using (s), (select unnest(range(13)) as d) where doc_id > first_id),
cut as (select doc_id, list(i) as gone from gone group by 1),
kept as (
  select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed, w, gone from words left join cut using (doc_id)),
places as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words),
texts as (
  select p.doc_id, string_agg(word, ' ' order by p.i) as kept
  from places p left join gone g on p.doc_id = g.doc_id and p.i = g.i where g.i is null group by 1)
select doc_id, n_words, n_removed, sha256(coalesce(t.kept, '')) as kept_sha256
from kept left join texts t using (doc_id)
"""


@query
def op12_pivot_clusters(spark, sf_dir):
    return centroids.with_inertia(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


def _clusters_sql(k: int, rounds: int) -> str:
    """All rounds written out one after the other."""
    steps = [
        f"""
points as materialized (
  select vec_id, unnest(range(64)) as dim, unnest([cast(floor(1024 * cast(x as double)) as bigint) for x in embedding]) as x
  from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64),
starts as (
  select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from (select distinct vec_id from points)),
c0 as materialized (select c, dim, x from points join starts using (vec_id) where c < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
d{i} as (select vec_id, c, sum((p.x - m.x) * (p.x - m.x)) as d from points p join c{i} m using (dim) group by 1, 2),
a{i} as materialized (
  select vec_id, c, d from d{i} qualify row_number() over (partition by vec_id order by d, c) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""
m{i} as (
  select c, dim, sum(x) as s, count(*) as n from points join a{i} using (vec_id) group by 1, 2),
c{i + 1} as materialized (
  select c, dim, coalesce(cast((s - ((s % n) + n) % n) // n as bigint), x) as x from c{i} left join m{i} using (c, dim))"""
            )
    return (
        "with "
        + ",".join(steps)
        + f"""
select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance,
  cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256
from a{rounds} join (
  select c, sha256(string_agg(cast(x as varchar), ',' order by dim)) as centroid_sha256 from c{rounds} group by 1) using (c)
"""
    )


ORACLES["op12_pivot_clusters"] = _clusters_sql(8, 10)


@query
def op13_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^.,;:!?\x0A-\x0D]+')) as p from documents),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
sizes as (select unnest([1, 2, 3, 4]) as k),
grams as (
  select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase from words, sizes),
counts as (select lang, k, phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f) as n from counts where k = 1 group by 1),
candidates as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k > 1 and f >= 30),
cuts as (
  select lang, phrase, a, k, j, array_to_string(w[1:j], ' ') as one, array_to_string(w[j + 1:], ' ') as two
  from candidates, (select unnest([1, 2, 3]) as j) where j < k),
scores as (
  select c.lang, c.phrase, c.a, j, x.f as l, y.f as r, (2000000 * c.a::hugeint) // (x.f + y.f) as score
  from cuts c join counts x on c.lang = x.lang and c.one = x.phrase join counts y on c.lang = y.lang and c.two = y.phrase),
worst as (select * from scores qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer
  from candidates, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as i) where m < k and i + m - 1 <= k group by 1, 2),
kept as (
  select w.* from worst w left join inside i using (lang, phrase) where longer is null or 100 * longer < 80 * a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""
