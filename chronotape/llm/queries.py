"""One query per operator on the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from chronotape.llm import (
    bulk_packing,
    byte_bpe,
    exact_dedup,
    jaccard_join,
    lexical_search,
    mixing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    token_packing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The rank file and splitting pattern of the token queries.
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Ids of a packed row, and the free id that ends a document.
ROW_IDS, END_ID = 2048, 50256


SUBSTRINGS = """with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
win as (select doc_id, p, md5(array_to_string(words[p:p + 34], ' ')) as h
 from (select doc_id, words, unnest(range(1, len(words) - 33)) as p from w where len(words) >= 35)),
rep as (select h from win group by h having count(*) > 1),
gone as (select distinct doc_id, p + i as p from (select doc_id, p, unnest(range(0, 35)) as i from win semi join rep using (h))),
kept as (select doc_id, len(words)::bigint as n_words, count(g.p)::bigint as n_removed,
  sha256(coalesce(string_agg(case when g.p is null then word end, ' ' order by p), '')) as kept_sha256
 from (select doc_id, words, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w) left join gone g using (doc_id, p)
 group by doc_id, words)
select * from kept union all select doc_id, 0::bigint, 0::bigint, sha256('') from w where len(words) = 0"""


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf).select("doc_id", "text")
    model = quality_classifier.fit(docs, quality_classifier.training_marks(read(spark, sf, "labels")))
    return quality_classifier.scored(docs, model).select(
        "doc_id",
        quality_classifier.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.ACCEPT).cast("int").alias("predicted"),
    )


@query("op3_token_packing")
def op3_token_packing(spark: SparkSession, sf: str) -> DataFrame:
    encoder = token_packing.rank_encoder(byte_bpe.Ranks(RANK_FILE).ranks, PATTERN)
    return token_packing.pack(token_packing.coded(read(spark, sf), encoder), ROW_IDS, END_ID)


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = byte_bpe.Ranks(RANK_FILE)
    return byte_bpe.digests(byte_bpe.encode(read(spark, sf).select("doc_id", "text"), ranks, PATTERN, scan=True), ranks)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf).select("doc_id", "text")
    encoded = byte_bpe.encode(docs, byte_bpe.Ranks(RANK_FILE), PATTERN, scan=True)
    return token_counts.histogram(encoded.select(F.size("ids").alias("n_tokens")))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(read(spark, sf), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op6_mixing",
    """with sizes as (select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
  coalesce(case when l.quality = 1 then 2.0::double when l.quality is not null then 0.5::double end, 1.0::double) as w, d.text
 from documents d left join (select doc_id, max(quality) as quality from labels where quality is not null group by 1) l using (doc_id)),
bytes as (select *, sum(size) over (partition by source) as source_size from sizes),
src as (select source, max(source_size) as s, (row_number() over (order by source nulls last) - 1) % 3 + 1 as wt from bytes group by 1),
lev as (select *, 3.0 * s / wt as full_at, sum(s) over () as total,
  sum(3 * s) over (order by 3.0 * s / wt, source nulls last rows between unbounded preceding and current row) - 3 * s as before,
  sum(wt) over (order by 3.0 * s / wt, source nulls last rows between current row and unbounded following) as left_wt,
  row_number() over (order by 3.0 * s / wt, source nulls last) as place from src),
com as (select min_by((total - before) / left_wt, place) as common from lev where (total - before) / left_wt <= full_at),
tgt as (select source, s::bigint as source_size, least(3.0 * s, coalesce(common * wt, 3.0 * s))::double as target from lev, com),
drawn as (select doc_id, size, t.source_size, t.target, z.source,
  -ln((('0x' || substr(md5(concat_ws('|', 'mix', doc_id, size)), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double) / w as draw
 from sizes z join tgt t on z.source is not distinct from t.source),
placed as (select *, coalesce(sum(size) over (partition by source order by draw, doc_id rows between unbounded preceding and 1 preceding), 0) as before,
  case when source_size > 0 then floor(target / source_size) else 0 end as epochs from drawn)
select doc_id, size, source_size, target, ((epochs + (epochs < 3 and size > 0 and before + size / 2.0::double <= target - epochs * source_size)::int) * size)::bigint as taken
from placed""",
)
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    weights = mixing.label_weights(read(spark, sf, "labels"))
    return mixing.mix(read(spark, sf), weights).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_substring_dedup", SUBSTRINGS)
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeats(read(spark, sf)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_copies(read(spark, sf)).select("doc_id", "class_id", "n_links")


@query(
    "op8_exact_dedup",
    """with t as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as bare
 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by bare) as group_size,
 row_number() over w = 1 as kept, sha256(bare) as text_sha256
from t window w as (partition by bare order by chars desc, doc_id nulls last)""",
)
def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.decisions(read(spark, sf)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


RANKED = r"""with bare as (select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
tf as (select doc_id, unnest(terms) as term, count(*) as tf from bare group by 1, 2),
size as (select doc_id, len(terms) as n from bare where len(terms) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as l from size),
weight as (select term, floor(1000 * ln((2.0 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, n_docs),
qry as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select item_id, term, count(*) as q from qry group by 1, 2),
scored as (select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))))::bigint as score
 from asked join weight using (term) join tf using (term) join size using (doc_id), total group by 1, 2),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20"""


@query("op11_lexical_search", RANKED)
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(read(spark, sf), read(spark, sf, "benchmark"), 20)


@query("op12_bulk_packing")
def op12_bulk_packing(spark: SparkSession, sf: str) -> DataFrame:
    encoder = bulk_packing.library_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    cut, places = bulk_packing.pack(read(spark, sf), encoder, ROW_IDS, 0)
    slim = cut.select("piece_no", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return slim.join(places, "piece_no").drop("piece_no")


TRIE = """with plain as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
lists as (select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as l from plain group by 1),
crc as (select conv_id, l, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 as h from lists),
built as (select c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) as path
 from crc c left join lists b on b.conv_id = c.conv_id - c.conv_id % 100),
member as (select conv_id, len(path) as n, path[1:d] as prefix, d from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from built)),
node as (select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, case when d > 0 then (count(*) - 1) * length(prefix[d].text) else 0 end as own,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256 from member group by 1, 2),
child as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as n_children from node where d > 0 group by 1, 2),
up as (select unnest(range(0, n.d + 1)) as a, n.prefix as whole, own, n_children is null as leaf from node n left join child c on c.d = n.d and c.prefix = n.prefix),
below as (select a as d, whole[1:a] as prefix, sum(own)::bigint as saved_tokens, sum(leaf::int)::bigint as n_leaves from up group by 1, 2)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
from node n join below b on b.d = n.d and b.prefix = n.prefix left join child c on c.d = n.d and c.prefix = n.prefix
left join node p on p.d = n.d - 1 and p.prefix = n.prefix[1:n.d - 1]"""


@query("op13_prefix_trie", TRIE)
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns, members = prefix_trie.rebuilt(prefix_trie.numbered_turns(read(spark, sf, "conversations")), 100, 6)
    return prefix_trie.trie(turns, members)
