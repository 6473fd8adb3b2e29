"""The queries of this subpackage: each applies one operator with its production parameters to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.op1_packing import pack_power_of_two
from graphmill.llm.op2_token_counts import corpus_totals
from graphmill.llm.op3_minhash import near_duplicates
from graphmill.llm.op4_quality import judge
from graphmill.llm.op5_language import identify, learn
from graphmill.llm.op6_rotated_codes import nearest
from graphmill.llm.op7_secrets import scan
from graphmill.llm.op8_line_dedup import dedup_lines
from graphmill.llm.op9_bpe import encode_decode
from graphmill.llm.op10_toxicity import THRESHOLD, remainder, score, train
from graphmill.llm.op11_pairwise_quality import judge as rank_quality
from graphmill.llm.op12_phrases import mine_phrases
from graphmill.llm.op13_filter_audit import filter_audit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence of its own."""
    return pack_power_of_two(table(spark, sf_dir, "documents"), with_ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the corpus at each document length taken as context limit."""
    return corpus_totals(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents by four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the log-likelihood ratio."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    out = identify(docs, learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's score."""
    return scan(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its duplicate lines."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "emptied")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text."""
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    out = score(docs.select("doc_id", "text"), train(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, ranked by pairs from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    out = rank_quality(docs.select("doc_id", "text"), labels.where(~held_out), pass_on=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_minhash, op4_quality, op5_language, op6_rotated_codes, op7_secrets, op8_line_dedup, op9_bpe, op10_toxicity, op11_pairwise_quality, op12_phrases, op13_filter_audit, pipeline)}

#: Nearest neighbours over all pairs for op6, exact inner products from left to right; all phrases for op12, grouped as text; all texts for op13.
#: The other operators need a tokenizer, a trained model or an iteration, which SQL doesn't have; tests hold them against brute force.
ORACLE_SQL = {
    "op6_rotated_codes": """
with v as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), d as (
  select len(v) as n from v group by 1 order by count(*) desc, 1 limit 1
), u as (select vec_id, v from v where len(v) = (select n from d)
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from u q join u c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0
), r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op12_phrases": r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from d),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by 1),
g as (select lang, w, unnest(range(1, len(w) + 1)) as i from w where len(w) > 0),
e as (select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3 from g),
f as (select lang, 1 as k, w1 as phrase, count(*) as a from e group by 1, 2, 3 having count(*) >= 10),
f2 as (select lang, 2 as k, w1, w2, null::varchar as w3, count(*) as a from e where w2 is not null group by 1, 2, 3, 4 having count(*) >= 10),
f3 as (select lang, 3 as k, w1, w2, w3, count(*) as a from e where w3 is not null group by 1, 2, 3, 4, 5 having count(*) >= 10),
s2 as (select c.lang, c.k, c.w1 || ' ' || c.w2 as phrase, c.a, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as score, 1 as z from f2 c join f x on x.lang = c.lang and x.phrase = c.w1 join f y on y.lang = c.lang and y.phrase = c.w2),
s3 as (select c.lang, c.k, c.w1 || ' ' || c.w2 || ' ' || c.w3 as phrase, c.a, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as score, 1 as z from f3 c join f x on x.lang = c.lang and x.phrase = c.w1 join f2 y on y.lang = c.lang and y.w1 = c.w2 and y.w2 = c.w3
  union all select c.lang, c.k, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, x.a, y.a, (1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a), 2 from f3 c join f2 x on x.lang = c.lang and x.w1 = c.w1 and x.w2 = c.w2 join f y on y.lang = c.lang and y.phrase = c.w3),
b as (select * from s3 qualify row_number() over (partition by lang, phrase order by score, z) = 1),
m as (select lang, phrase, max(a) as longer from (select lang, w1 || ' ' || w2 as phrase, a from f3 union all select lang, w2 || ' ' || w3, a from f3) group by 1, 2),
u as (select s2.* from s2 left join m using (lang, phrase) where coalesce(100 * longer < 50 * s2.a, true) union all select * from b),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from u)
select r.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from r join t on t.lang = r.lang where rank <= 2000
""",
    "op13_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
f as (select doc_id, part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as o from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select o, s, 1 << (ascii(o[s]) - 65) as f, coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))), 0)::bigint as b from o, (select unnest(range(1, 6)) as s)),
r as (select part, o, s, f, sum(case when mask & (b | f) = 0 then n else 0 end)::bigint as kept, sum(case when mask & b = 0 and mask & f <> 0 then n else 0 end)::bigint as removed,
  sum(case when mask & b <> 0 and mask & f <> 0 then n else 0 end)::bigint as redundant, sum(case when mask = f then n else 0 end)::bigint as unique_fails,
  sum(case when mask & b = 0 and mask & f <> 0 then good else 0 end)::bigint as good_lost, sum(case when mask & b = 0 and mask & f <> 0 then toxic else 0 end)::bigint as toxic_lost from c, s group by 1, 2, 3, 4)
select part, o as filter_order, s::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from r
""",
}
