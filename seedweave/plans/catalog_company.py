"""Queries for tags, voting and the company classification job
(P7-P10, A16, A17, J9, J14, X26, S16, F11, F14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.operators import dedup as dd
from seedweave.operators import mapping as mp
from seedweave.operators import match
from seedweave.operators import vote as vt
from seedweave.operators.common import cut_lineage, local_table
from seedweave.plans.fixtures import (ACQ_DATE, SEEDS, TAG_IDS, TAG_LINKS, TAG_SYNONYMS,
                                      TEXT_TAG_IDS, TEXT_TAG_LINKS, TEXT_TAGS, WORD_CATEGORY, ids_values_sql,
                                      pairs_values_sql, seeds_values_sql, sql_ngrams_upto, sql_str,
                                      sql_word_tokens, synonyms_values_sql)
from seedweave.plans.registry import query
from seedweave.session import table
from seedweave.sources.dictionaries import seeds_from_dict

LABELS = sorted(SEEDS)

def _syn_df(spark, syn):
    return local_table(spark, [(t, w) for t, ws in syn.items() for w in ws], ["tag", "word"])


def _ids_df(spark, ids):
    return local_table(spark, list(ids.items()), ["tag", "tag_id"], ["string", "int"])


def _links_df(spark, links):
    return local_table(spark, links, ["src", "dst"], ["int", "int"])


def _tag_sql(docs_sql: str, syn: dict, ids: dict, links) -> str:
    return f"""
d AS {docs_sql},
g AS (SELECT doc_id, list_distinct({sql_ngrams_upto(sql_word_tokens('text'), 4)}) AS grams FROM d),
tok AS (SELECT doc_id, unnest(grams) AS word FROM g),
syn AS (SELECT DISTINCT tag, word FROM {synonyms_values_sql(syn)}),
hit AS (SELECT DISTINCT tok.doc_id, i.tag_id FROM tok JOIN syn USING (word) JOIN {ids_values_sql(ids)} i USING (tag)),
lnk AS {pairs_values_sql(links, 'src', 'dst', types=('int', 'int'))},
ex AS (SELECT doc_id, tag_id FROM hit UNION SELECT hit.doc_id, lnk.dst FROM hit JOIN lnk ON lnk.src = hit.tag_id),
tags AS (SELECT DISTINCT doc_id, tag_id FROM ex WHERE tag_id IN (SELECT tag_id FROM {ids_values_sql(ids)}))
"""


_PART_DOCS_SQL = "(SELECT p_partkey AS doc_id, p_name || ' ' || lower(p_type) AS text FROM part)"


@query("p7_tag_matches", f"""
WITH {_tag_sql(_PART_DOCS_SQL, TAG_SYNONYMS, TAG_IDS, TAG_LINKS)}
SELECT doc_id, CAST(tag_id AS INT) AS tag_id FROM tags
""")
def p7_tag_matches(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"),
                                        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    return match.tag_matches(p, "text", _syn_df(spark, TAG_SYNONYMS), _ids_df(spark, TAG_IDS),
                             _links_df(spark, TAG_LINKS))


# --- company job -------------------------------------------------------------
# Conversations stand for company texts: a company has descriptions (user and system turns) and
# pitch lines (assistant turns); the customer table stands for the external source.
_DESC_CLASS = "[;,.!?()]"
DESC_ROLES, PITCH_ROLES = ["user", "system"], ["assistant"]
# Deliberately lacks "system": sources outside the list come last.
DESC_PRIORITY = ["user"]
SEGMENT_LABELS = [("BUILDING", "de"), ("MACHINERY", "en"), ("AUTOMOBILE", "fr"), ("HOUSEHOLD", "xx")]
SEGMENT_TAGS = [("BUILDING", 1), ("MACHINERY", 3), ("FURNITURE", 4)]
_CLEAN_TURN = f"replace(regexp_replace(lower(text), '{_DESC_CLASS}', ' ', 'g'), chr(10), ' ')"


def _kind_sql(name: str, roles: list[str], priority: list[str]) -> str:
    prio = "[" + ", ".join(sql_str(r) for r in priority) + "]"
    return f"""
{name}_lt AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text) AS rn
       FROM conversations WHERE role IN ({", ".join(sql_str(r) for r in roles)})),
{name} AS (SELECT conv_id, role, CAST(coalesce(list_position({prio}, role), 1000000) AS INT) AS prio,
              {_CLEAN_TURN} AS clean FROM {name}_lt WHERE rn = 1)"""


_TEXTS_SQL = f"""{_kind_sql("descr", DESC_ROLES, DESC_PRIORITY)},{_kind_sql("pitch", PITCH_ROLES, PITCH_ROLES)},
dropped AS (SELECT b.conv_id, b.role FROM descr a JOIN descr b ON a.conv_id = b.conv_id AND (a.prio, a.role) < (b.prio, b.role)
            AND 5 * levenshtein(a.clean, b.clean) < greatest(length(a.clean), length(b.clean))),
kept AS (SELECT * FROM descr WHERE (conv_id, role) NOT IN (SELECT (conv_id, role) FROM dropped)),
clients AS (SELECT conv_id FROM descr UNION SELECT conv_id FROM pitch),
seeds AS {seeds_values_sql(SEEDS)}"""


def _pseudo_sql(src: str, predtype: str) -> str:
    p = predtype
    return f"""
{p}_g AS (SELECT conv_id, role, list_distinct({sql_ngrams_upto(sql_word_tokens('clean'), 4)}) AS grams FROM {src}),
{p}_cnt AS (SELECT conv_id, role, label, count(*) AS n FROM (SELECT conv_id, role, unnest(grams) AS word FROM {p}_g)
        JOIN (SELECT DISTINCT label, word FROM seeds) s USING (word) GROUP BY conv_id, role, label),
{p}_st AS (SELECT *, n / sum(n) OVER (PARTITION BY conv_id, role) AS share,
              row_number() OVER (PARTITION BY conv_id, role ORDER BY n DESC, label) AS rk FROM {p}_cnt),
{p}_fin AS (SELECT *, max(CAST(share >= 0.2 AS INT)) OVER (PARTITION BY conv_id, role) AS anyp FROM {p}_st),
{p} AS (SELECT conv_id, '{p}' AS predtype, label, 1 AS weight FROM {p}_fin WHERE share >= 0.2 OR (anyp = 0 AND rk = 1))"""


_VOTES_SQL = f"""
{_TEXTS_SQL},{_pseudo_sql("kept", "pseudo_descr")},{_pseudo_sql("pitch", "pseudo_pitch")},
model_descr AS (SELECT conv_id, 'model_descr' AS predtype, label, 1 AS weight FROM pseudo_descr_st WHERE share > 0.5),
ext AS (SELECT DISTINCT c_custkey AS conv_id, 'ext' AS predtype, m.label, 5 AS weight FROM customer
        JOIN {pairs_values_sql(SEGMENT_LABELS, 'c_mktsegment', 'label')} m USING (c_mktsegment)
        WHERE m.label IN ({", ".join(sql_str(l) for l in LABELS)})),
votes AS (SELECT * FROM (SELECT * FROM pseudo_descr UNION ALL SELECT * FROM pseudo_pitch UNION ALL SELECT * FROM model_descr
          UNION ALL SELECT * FROM ext) WHERE conv_id IN (SELECT conv_id FROM clients)),
sums AS (SELECT conv_id, label, sum(weight) AS votes FROM votes GROUP BY conv_id, label),
grid AS (SELECT c.conv_id, l.label FROM clients c, (SELECT unnest([{', '.join(sql_str(l) for l in LABELS)}]) AS label) l),
dense AS (SELECT grid.conv_id, grid.label, CAST(coalesce(sums.votes, 0) AS BIGINT) AS votes
          FROM grid LEFT JOIN sums USING (conv_id, label)),
picked AS (SELECT conv_id, label, votes FROM (SELECT *, avg(votes) OVER (PARTITION BY conv_id) AS mean FROM dense)
           WHERE votes > mean + 1)
"""


def _texts(spark, sf):
    c = table(spark, sf, "conversations")
    kinds = ((DESC_ROLES, DESC_PRIORITY), (PITCH_ROLES, PITCH_ROLES))
    return [vt.company_texts(c.where(F.col("role").isin(roles)), "conv_id", "role", "turn", "text", priority)
            for roles, priority in kinds]


def _external(spark, sf, mapping, value, kind):
    m = local_table(spark, mapping, ["c_mktsegment", value], ["string", kind])
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("conv_id"), "c_mktsegment")
    return c.join(m, "c_mktsegment").select("conv_id", value)


def _model_output(spark, descr):
    """What an external model returns for each description: label names and confidences (here: shares of the seed hits)."""
    docs = descr.select(F.struct("conv_id", "role").alias("doc_id"), "clean")
    from seedweave.functions.text import ngrams_upto, word_tokens
    grams = match.explode_tokens(docs, ngrams_upto(word_tokens("clean"), 4), distinct=True)
    counts = match.label_counts(grams, seeds_from_dict(spark, SEEDS))
    per_text = counts.groupBy("doc_id").agg(F.collect_list(F.struct("label", "n")).alias("x"), F.sum("n").alias("total"))
    return per_text.select(F.col("doc_id.conv_id").alias("conv_id"),
                           F.transform("x", lambda s: F.concat(F.lit("__label__"), s["label"])).alias("names"),
                           F.transform("x", lambda s: s["n"] / F.col("total")).alias("confidences"))


def _company(spark, sf, duplicates="levenshtein"):
    descr, pitch = _texts(spark, sf)
    # Cleaned, ordered and rid of duplicates once, for the model's votes and for the job's own.
    kept = cut_lineage(vt.without_duplicates(descr, "conv_id", "role", duplicates))
    model = vt.model_votes(_model_output(spark, kept), "conv_id", "names", "confidences", LABELS, "model_descr")
    return vt.classify_companies(kept, pitch, seeds_from_dict(spark, SEEDS), LABELS, "conv_id", "role", [model],
                                 _external(spark, sf, SEGMENT_LABELS, "label", "string"), None)


@query("p10_votes_by_predictor", f"""
WITH {_VOTES_SQL}
SELECT conv_id, predtype, label, CAST(sum(weight) AS BIGINT) AS votes FROM votes GROUP BY conv_id, predtype, label
""")
def p10_votes_by_predictor(spark, sf):
    """P10: what each predictor votes for each company."""
    votes, _, _ = _company(spark, sf)
    return votes.groupBy("conv_id", "predtype", "label").agg(F.sum("weight").cast("long").alias("votes"))


@query("a16_vote_sum", f"""
WITH {_VOTES_SQL}
SELECT conv_id, label, votes FROM dense
""")
def a16_vote_sum(spark, sf):
    return _company(spark, sf)[1]


@query("a17_adaptive_pick", f"""
WITH {_VOTES_SQL}
SELECT conv_id, label, votes FROM picked
""")
def a17_adaptive_pick(spark, sf):
    return _company(spark, sf)[2]


def _vertical_rows(spark, sf, picked):
    clients = table(spark, sf, "conversations").where(F.col("role").isin(DESC_ROLES + PITCH_ROLES)).select("conv_id")
    rows = vt.vertical_rows(picked, clients, "conv_id", LABELS, ACQ_DATE)
    return rows.select("client_id", F.col("vertical_id").cast("string").alias("vertical_id"),
                       F.date_format("acq_date", "yyyy-MM-dd HH:mm:ss").alias("acq_date"))


@query("p10_company_labels", f"""
WITH {_VOTES_SQL},
ids AS (SELECT conv_id, CAST(list_position([{', '.join(sql_str(l) for l in LABELS)}], label) - 1 AS INT) AS vertical_id
        FROM picked)
SELECT c.conv_id AS client_id, CAST(ids.vertical_id AS VARCHAR) AS vertical_id, CAST('{ACQ_DATE}' AS VARCHAR) AS acq_date
FROM clients c LEFT JOIN ids USING (conv_id)
""")
def p10_company_labels(spark, sf):
    """P10 + S16: vertical rows per company (NULL vertical when none is picked), duplicates by edit distance."""
    return _vertical_rows(spark, sf, _company(spark, sf)[2])


@query("p10_company_labels_indel")
def p10_company_labels_indel(spark, sf):
    """P10 with the reference's own duplicate rule (indel ratio over 80.5; brute force in pytest)."""
    return _vertical_rows(spark, sf, _company(spark, sf, "indel")[2])


_COMPANY_DOCS_SQL = f"""(WITH {_TEXTS_SQL},
  x AS (SELECT conv_id, 0 AS kind, prio, role, clean FROM descr UNION ALL SELECT conv_id, 1, prio, role, clean FROM pitch)
  SELECT conv_id AS doc_id, string_agg(clean, ' ' ORDER BY kind, prio, role) AS text FROM x GROUP BY conv_id)"""


@query("p10_company_tags", f"""
WITH {_tag_sql(_COMPANY_DOCS_SQL, TEXT_TAGS, TEXT_TAG_IDS, TEXT_TAG_LINKS)},
ext AS (SELECT c_custkey AS doc_id, m.tag_id FROM customer
        JOIN {pairs_values_sql(SEGMENT_TAGS, 'c_mktsegment', 'tag_id', types=('str', 'int'))} m USING (c_mktsegment)),
all_tags AS (SELECT doc_id, tag_id FROM tags UNION SELECT doc_id, tag_id FROM ext)
SELECT d.doc_id AS client_id, CAST(t.tag_id AS VARCHAR) AS tag_id, CAST('{ACQ_DATE}' AS VARCHAR) AS acq_date
FROM d LEFT JOIN all_tags t USING (doc_id)
""")
def p10_company_tags(spark, sf):
    """P10 + U4 + S16: tag rows per company from the whole text in priority order, united with external tags."""
    rows = vt.tag_rows(_texts(spark, sf), "conv_id", "role", _syn_df(spark, TEXT_TAGS), _ids_df(spark, TEXT_TAG_IDS),
                       _links_df(spark, TEXT_TAG_LINKS), _external(spark, sf, SEGMENT_TAGS, "tag_id", "int"), ACQ_DATE)
    return rows.select("client_id", F.col("tag_id").cast("string").alias("tag_id"),
                       F.date_format("acq_date", "yyyy-MM-dd HH:mm:ss").alias("acq_date"))


@query("p9_exact_duplicates", f"""
WITH {_TEXTS_SQL}
SELECT conv_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, clean ORDER BY prio, role) AS r FROM descr) WHERE r = 1
""")
def p9_exact_duplicates(spark, sf):
    return dd.drop_exact_duplicates(_texts(spark, sf)[0], "conv_id", ["prio", "role"], "clean").select("conv_id", "role")


def _all_turns(spark, sf):
    c = table(spark, sf, "conversations")
    from seedweave.functions.text import description_clean
    return c.select("conv_id", "turn", description_clean("text").alias("clean"))


@query("p9_near_duplicates")
def p9_near_duplicates(spark, sf):
    """P9 over all turns of each conversation (order = turn): indel ratio > 80.5 drops the later text (P)."""
    return dd.drop_near_duplicates(_all_turns(spark, sf), "conv_id", ["turn"], "clean").select("conv_id", "turn")


@query("x26_similarity")
def x26_similarity(spark, sf):
    """X26 + J14: indel similarity of every length-feasible pair of turns in a conversation (P)."""
    pairs = dd.similarities(_all_turns(spark, sf), "conv_id", "turn", "clean")
    return pairs.select("conv_id", "a_ord", "b_ord", F.round("ratio", 6).alias("ratio"))


@query("p9_levenshtein_variant", """
WITH t AS (SELECT conv_id, turn, replace(regexp_replace(lower(text), '[;,.!?()]', ' ', 'g'), chr(10), ' ') AS clean
           FROM conversations),
p AS (SELECT a.conv_id, b.turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn
      AND 5 * levenshtein(a.clean, b.clean) < greatest(length(a.clean), length(b.clean))
      AND 5 * abs(length(a.clean) - length(b.clean)) < greatest(length(a.clean), length(b.clean)))
SELECT conv_id, turn FROM t WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM p)
""")
def p9_levenshtein_variant(spark, sf):
    """P9 with edit-distance similarity 1 - lev/max_len > 0.8 (built-in levenshtein)."""
    return dd.drop_levenshtein_duplicates(_all_turns(spark, sf), "conv_id", ["turn"], "clean").select("conv_id", "turn")


_EXT_SQL = f"""
p AS (SELECT p_partkey, p_brand AS client_id, replace(p_name, ' ', ' / ') AS vertical, p_name FROM part),
v AS (SELECT p_partkey, client_id, trim(unnest(string_split(vertical, '/'))) AS key FROM p),
vm AS (SELECT p_partkey, client_id, list_sort(list_distinct(list(m.value))) AS verts
       FROM v JOIN {pairs_values_sql(WORD_CATEGORY, 'key', 'value')} m USING (key) GROUP BY p_partkey, client_id),
kw AS (SELECT DISTINCT tag, word FROM {synonyms_values_sql(TAG_SYNONYMS)}),
tg AS (SELECT p.p_partkey, p.client_id, list_sort(list_distinct(list(i.tag_id))) AS tags
       FROM p JOIN kw ON contains(p.p_name, kw.word) JOIN {ids_values_sql(TAG_IDS)} i USING (tag)
       GROUP BY p.p_partkey, p.client_id),
both_ AS (SELECT vm.client_id, vm.verts, tg.tags FROM vm JOIN tg USING (p_partkey, client_id)
          WHERE len(vm.verts) > 0 AND len(tg.tags) > 0)
"""


@query("p8_external_labels", f"""
WITH {_EXT_SQL},
vv AS (SELECT client_id, string_agg(DISTINCT x, ',' ORDER BY x) AS verticals
       FROM (SELECT client_id, unnest(verts) AS x FROM both_) GROUP BY client_id),
tt AS (SELECT client_id, string_agg(DISTINCT CAST(x AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR)) AS tags
       FROM (SELECT client_id, unnest(tags) AS x FROM both_) GROUP BY client_id)
SELECT client_id, verticals, tags FROM vv JOIN tt USING (client_id)
""")
def p8_external_labels(spark, sf):
    """Split slash lists, map to verticals, keyword tags by containment, keep rows
    with both, merge per client (A18) and join the two aggregates (J6)."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("client_id"),
                                        F.replace("p_name", F.lit(" "), F.lit(" / ")).alias("vertical"), "p_name")
    wc = local_table(spark, WORD_CATEGORY, ["key", "value"])
    verts = mp.distinct_mapped_list(p, "p_partkey", "vertical", wc, sep="/").withColumnRenamed("labels", "verts")
    kw = _syn_df(spark, TAG_SYNONYMS).distinct()
    hits = mp.keyword_containment(p, "p_name", kw, "word").join(_ids_df(spark, TAG_IDS), "tag")
    tags = hits.groupBy("p_partkey").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    both = (p.select("p_partkey", "client_id").join(verts, "p_partkey").join(tags, "p_partkey")
            .where((F.size("verts") > 0) & (F.size("tags") > 0)))                       # F11
    av = mp.concat_distinct_lists(both, "client_id", "verts")                          # A18
    at = mp.concat_distinct_lists(both.select("client_id", F.col("tags").cast("array<string>").alias("tags")),
                                  "client_id", "tags")
    out = av.join(at, "client_id")                                                     # J6
    return out.select("client_id", F.array_join("verts", ",").alias("verticals"), F.array_join("tags", ",").alias("tags"))
