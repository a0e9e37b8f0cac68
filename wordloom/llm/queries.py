"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(k: int) -> Column:
    """The remainder by which rows are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(k))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.toxicity import score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_toxicity(docs, docs.where(fold(3) != 1), labels.where(fold(3) != 1))
    held_out = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.langid import identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(fold(4) != 2))
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.line_rules import clean_lines

    out = clean_lines(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.minhash_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.line_dedup import drop_shared_lines

    out = drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, i, line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wordloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.mixing import mix_sources

    out = mix_sources(table(spark, sf_dir, "documents"), share=1.5, cap=2.0, weights=(5, 2, 1))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.run_index import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


OP9_SQL = r"""
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM fine),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(c.v, q.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (c.norm * q.norm) AS score
  FROM normed q JOIN normed c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wordloom.llm.secrets import find_secrets, joined

    out = find_secrets(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.repair import repair_conversations

    out = repair_conversations(_damaged(table(spark, sf_dir, "conversations")))
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """The damage that the contract orders, by a hash of conversation and turn."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(named) % 20).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate != 0).alias("present"), twice.alias("again"))


#: DuckDB has no crc32: a step for each byte, and eight for its bits.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


def _option(cost: str, label: str, to: str, line: str | None, allowed: str = "true") -> str:
    """SQL of one edit's path: its cost, labels and lines before those of the state that it leads to."""
    lines = f"{to}.t" if line is None else f"list_prepend({line}, {to}.t)"
    return f"CASE WHEN {allowed} THEN {{'c': {to}.c + {cost}, 'l': '{label}' || {to}.l, 't': {lines}}} END"


def _best(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


_SOUND, _WORSE = "fault NOT IN (1, 2)", "5 * (fault = 3)::BIGINT"
#: For each state of the grammar: the state that a written role leads to and the role, and the initials that it keeps.
_STATES = ((2, "user", {"s": 1, "u": 2}), (2, "user", {"u": 2}), (3, "assistant", {"a": 3}), (2, "user", {"u": 2}))


def _edits_of(g: int) -> str:
    to, role, arcs = _STATES[g]
    keeps = [_option(_WORSE, "K", f"s{k}", "role || ':' || text", f"{_SOUND} AND role[1] = '{x}'") for x, k in arcs.items()]
    return _best(_option("2", "D", f"s{g}", None), *keeps, _option(f"1 + {_WORSE}", "R", f"s{to}", f"'{role}:' || text", _SOUND))


#: Paths from the last row backwards, for the four states of the grammar at once; insertions come after a row's own edits.
OP11_SQL = rf"""
WITH RECURSIVE fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) FROM fates WHERE fate <> 0)),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lead(role[1]) OVER w AS following FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault FROM o),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE i < n AND role[1] || following NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
paths AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 'l': '', 't': []::VARCHAR[]}} AS s0, {{'c': 10::BIGINT, 'l': 'II', 't': ['user:', 'assistant:']}} AS s1,
         {{'c': 5::BIGINT, 'l': 'I', 't': ['assistant:']}} AS s2, {{'c': 0::BIGINT, 'l': '', 't': []::VARCHAR[]}} AS s3 FROM f WHERE i = n
  UNION ALL
  SELECT conv_id, i, {_best("b0", _option("5", "I", "n2", "'user:'"))} AS s0, {_best("b1", _option("5", "I", "n2", "'user:'"))} AS s1, n2 AS s2, {_best("b3", _option("5", "I", "b2", "'user:'"))} AS s3
  FROM (SELECT *, {_best("b2", _option("5", "I", "b3", "'assistant:'"))} AS n2
    FROM (SELECT f.conv_id, f.i, {", ".join(f"{_edits_of(g)} AS b{g}" for g in range(4))} FROM paths p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i - 1)))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s0.c, 0) AS cost, coalesce(s0.l, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN paths p ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.i = 1
"""


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.url_rules import judge_urls

    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(rules, "host string, path string, verdict string"))


OP12_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rest),
best AS (
  SELECT n, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(verdict, length(r.host || r.path)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN best USING (n)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.prefix_trie import conversations, prefix_trie

    own = conversations(table(spark, sf_dir, "conversations"))
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    none = F.array().cast(own.schema["turns"].dataType)
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    rebuilt = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    linked = own.join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("base"), "left")
    return prefix_trie(linked.select("conv_id", rebuilt.alias("turns")))


OP13_SQL = rf"""
WITH rows AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
marked AS (SELECT *, md5(length(role)::VARCHAR || ':' || role || text) AS t, len(regexp_extract_all(text, '[^ 	-
]+'))::BIGINT AS w FROM rows),
own AS (SELECT c, list(t ORDER BY turn NULLS FIRST, t) AS ts, list(w ORDER BY turn NULLS FIRST, t) AS ws FROM marked GROUP BY c),
cut AS (SELECT *, ({CRC32.format("c::VARCHAR")} % 4)::BIGINT AS h FROM own),
built AS (
  SELECT x.c, list_concat(coalesce(b.ts[1:x.h], []), x.ts[x.h + 1:]) AS ts, list_concat(coalesce(b.ws[1:x.h], []), x.ws[x.h + 1:]) AS ws
  FROM cut x LEFT JOIN own b ON b.c = x.c - x.c % 20),
members AS (SELECT c, d, len(ts) AS n, md5(array_to_string(ts[1:d], ',')) AS node, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM built)),
nodes AS (
  SELECT node, d, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
  FROM members GROUP BY node, d),
above AS (SELECT x.node, x.d, m.node AS up, m.d AS up_d, x.saved FROM nodes x JOIN members m ON m.c = x.c AND m.d <= x.d),
kids AS (SELECT up AS node, up_d AS d, count(*) AS n FROM above WHERE up_d = d - 1 GROUP BY ALL),
sums AS (
  SELECT a.up AS node, a.up_d AS d, sum(a.saved)::BIGINT AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM above a LEFT JOIN kids k ON k.node = a.node AND k.d = a.d GROUP BY ALL)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums s ON s.node = x.node AND s.d = x.d LEFT JOIN kids k ON k.node = x.node AND k.d = x.d
LEFT JOIN above a ON a.node = x.node AND a.d = x.d AND a.up_d = x.d - 1 LEFT JOIN nodes p ON p.node = a.up AND p.d = a.up_d
"""


WORDS_SQL = r"'[^\x20\x09-\x0D]+'"


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: the base statistics and their verdict."""
    return op2_quality_rules(spark, sf_dir).drop("kept", "words_left")


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS_SQL}) AS ws FROM documents),
windows AS (SELECT doc_id, i, ws[i:i + 4] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
again AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, w, list(i) AS places FROM windows GROUP BY doc_id, w HAVING count(*) > 1)),
inside AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(5) r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE regexp_matches(line, {WORDS_SQL}) GROUP BY doc_id),
s AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
"""


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: how often each base pattern is found, by the
    step of the operator that finds them."""
    from wordloom.llm.secrets import base_spans

    return base_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


SECRETS_SQL = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24))::BIGINT AS n_hex
FROM documents
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: sizes, and whether the words taken of each
    source are within a hundredth (or two words) of its target."""
    out = op6_mix_sources(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    each = out.join(docs, "doc_id").groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.greatest(F.lit(2.0), F.col("target") / 100)
    return each.select("source", "source_size", F.round("target").cast("long").alias("target"), near.alias("near"))


#: Shares the excess of capped sources again, a level at a time, by the order in which they reach their caps.
TARGETS_SQL = rf"""
WITH sized AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), {WORDS_SQL})))::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, 2.0 * source_size AS most FROM sized),
o AS (
  SELECT *, coalesce(sum(most) OVER b, 0) AS capped, coalesce(sum(weight) OVER b, 0) AS used, sum(weight) OVER () AS every, 1.5 * sum(source_size) OVER () AS budget
  FROM w WINDOW b AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((budget - capped) / (every - used), most / weight) AS level FROM o WHERE (budget - capped) / (every - used) * weight <= most)
SELECT source, source_size, round(least(most, coalesce(level * weight, most)))::BIGINT AS target, true AS near FROM o, l
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op8_language_id": op8_language_id,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_mix_sources": op6_mix_sources,
        "op7_run_index_dedup": op7_run_index_dedup,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_secret_scan": op10_secret_scan,
        "op11_repair_conversations": op11_repair_conversations,
        "op12_url_rules": op12_url_rules,
        "op13_prefix_trie": op13_prefix_trie,
        "quality_base": quality_base,
        "secret_base": secret_base,
        "mix_targets": mix_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op9_nearest_neighbours": OP9_SQL, "op11_repair_conversations": OP11_SQL, "op12_url_rules": OP12_SQL, "op13_prefix_trie": OP13_SQL, "quality_base": QUALITY_SQL, "secret_base": SECRETS_SQL, "mix_targets": TARGETS_SQL}
