"""Queries over the operators of this package, and their SQL where SQL can say the same.

Without SQL: p2 and p3 (trained models, tested on held-out rows), p6 and p7 (a
tokenizer; tested against brute force), p8 (calibrated measures; tested on a
labelled fixture). p5_survivors' voted fields come from an iterative estimate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import conversations, formatting_dups, fusion, mixing, packing, pii, residue, stuffing
from loomline.session import cut_lineage, table


def _groups(spark: SparkSession, root: str) -> DataFrame:
    return formatting_dups.grouped(formatting_dups.finding_keys(table(spark, root, "cie_records"), table(spark, root, "records")))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Copies that differ only in form, against the first row of their finding."""
    return formatting_dups.copies(_groups(spark, root))


def p1_collapsed(spark: SparkSession, root: str) -> DataFrame:
    """One row a finding with its number of rows and of occurrences."""
    return formatting_dups.collapse(_groups(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Kinds of personal data in each turn and in the quotes of each record."""
    return pii.found(table(spark, root, "turns"), table(spark, root, "records"), pii.train(table(spark, root, "roster")))


def p2_masked_turns(spark: SparkSession, root: str) -> DataFrame:
    """Turns with placeholders for mentions."""
    return pii.masked_turns(table(spark, root, "turns"), pii.train(table(spark, root, "roster")))


def p2_masked_records(spark: SparkSession, root: str) -> DataFrame:
    """Records with masked quotes and a fitting sensitivity."""
    return pii.masked_records(table(spark, root, "records"), pii.train(table(spark, root, "roster")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Turns whose text or tool name is no content."""
    return residue.residue(table(spark, root, "turns"))


def p3_clean_turns(spark: SparkSession, root: str) -> DataFrame:
    """Turns with content."""
    return residue.clean(table(spark, root, "turns"))


def p3_validation(spark: SparkSession, root: str) -> DataFrame:
    """Precision and recall of the classifier on sessions it hasn't seen."""
    return residue.validation(table(spark, root, "turns"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Sessions that must be dropped."""
    return conversations.verdicts(table(spark, root, "messages")).where("reason IS NOT NULL").select("session_id")


def p4_conversations(spark: SparkSession, root: str) -> DataFrame:
    """The kept sessions as ordered rows of role and content."""
    return conversations.conversations(table(spark, root, "messages"))


def _register_groups(spark: SparkSession, root: str, carried: tuple[str, ...]) -> DataFrame:
    keys = formatting_dups.keyed(fusion.prepared(table(spark, root, "cie_records")), F.lit("cie_records"), "record_id", "statement", *carried)
    return formatting_dups.grouped(keys).drop("src")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The row that gives each settled field of each group of duplicates, by the owner's order."""
    return fusion.field_winners(_register_groups(spark, root, fusion.PREFERRED))


def p5_survivors(spark: SparkSession, root: str) -> DataFrame:
    """One surviving record for each group of duplicates."""
    return fusion.survivors(cut_lineage(_register_groups(spark, root, fusion.CARRIED)), table(spark, root, "cie_records"))


def _capacity(spark: SparkSession, root: str) -> int:
    return int(table(spark, root, "pack_spec").orderBy("spec_id").first()["capacity_tokens"])


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the packing had to split."""
    return packing.pack(table(spark, root, "documents"), _capacity(spark, root)).where("piece = 1").select("doc_id")


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    """Documents, whole or in pieces, with their containers."""
    return packing.pack(table(spark, root, "documents"), _capacity(spark, root))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Containers with their use."""
    n = _capacity(spark, root)
    return packing.containers(packing.pack(table(spark, root, "documents"), n), n)


def p6_checks(spark: SparkSession, root: str) -> DataFrame:
    """Whether the packing keeps its promises, as one row."""
    n, docs = _capacity(spark, root), table(spark, root, "documents")
    return packing.checks(cut_lineage(packing.pack(docs, n)), docs, n)


def p7_checks(spark: SparkSession, root: str) -> DataFrame:
    """Whether the selection keeps its promises, by source."""
    sizes, targets = mixing.sizes_of(table(spark, root, "documents")), table(spark, root, "mix_targets")
    return mixing.checks(mixing.mixed(sizes, targets)[0], sizes, targets)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources that can't reach their share."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1].where("NOT reachable").select("source")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Shares wanted and reached of each source."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p7_selection(spark: SparkSession, root: str) -> DataFrame:
    """The mixed selection in global random order."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages made of keywords, links or tags."""
    return stuffing.stuffed(table(spark, root, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p1_found, p1_collapsed, p2_found, p2_masked_turns, p2_masked_records, p3_found, p3_clean_turns, p3_validation, p4_found, p4_conversations,
        p5_found, p5_survivors, p6_found, p6_packed, p6_containers, p6_checks, p7_found, p7_shares, p7_selection, p7_checks, p8_found,
    )
    return {f.__name__: f for f in own}


def _fold(x: str) -> str:
    return rf"regexp_replace(lower(upper({x})), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_PIECE = r"'^[^\p{L}\p{N}]*[\p{L}\p{N}][^:=;|\n{}\[\]]*[:=]'"


def _by(sep: str) -> str:
    parts = f"list_filter(string_split(t, {sep}), lambda p: {_fold('p')} <> '')"
    ok = f"len({parts}) >= 2 AND len(list_filter({parts}, lambda p: NOT regexp_matches(p, {_PIECE}))) = 0"
    name = _fold(r"regexp_extract(p, '^([^:=]*)[:=]', 1)")
    value = _fold(r"regexp_replace(p, '^[^:=]*[:=]', '')")
    return f"WHEN {ok} THEN 'F' || array_to_string(list_sort(list_transform({parts}, lambda p: {name} || '=' || {value})), chr(30))"


def _group_sql(source: str) -> str:
    """(src, rid, n, g): rows with the name of their group. The fields of records are sorted; the rest is folded."""
    pairs = "list_transform(json_keys(t), lambda k: {0} || '=' || {1})".format(_fold("k"), _fold("json_extract_string(t, '$.\"' || k || '\"')"))
    return f"""
      SELECT src, rid, n, min(CASE
        WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN 'F' || array_to_string(list_sort({pairs}), chr(30))
        {_by("';'")} {_by("'|'")} {_by("chr(10)")}
        ELSE 'T' || {_fold("t")} END) OVER (PARTITION BY src, {_fold("t")}) AS g
      FROM ({source}) WHERE t IS NOT NULL AND rid IS NOT NULL"""


_BOTH = """SELECT 'cie_records' AS src, record_id AS rid, coalesce(occurrence_count, 1) AS n, trim(replace(statement, chr(8203), '')) AS t FROM cie_records
      UNION ALL SELECT 'records', record_id, 1, trim(replace(summary, chr(8203), '')) FROM (SELECT DISTINCT record_id, summary FROM records)"""
_REGISTER = "SELECT 'cie_records' AS src, record_id AS rid, 1 AS n, trim(replace(statement, chr(8203), '')) AS t FROM cie_records"

_P4 = r"""
WITH kept AS (
  SELECT DISTINCT id, session_id, lower(regexp_replace(coalesce(role, ''), '^[\s\pZ\pC]+|[\s\pZ\pC]+$', '', 'g')) AS r, content,
    CASE WHEN timestamp < 1e11 THEN timestamp WHEN timestamp < 1e14 THEN timestamp / 1e3 ELSE timestamp / 1e6 END AS sec
  FROM messages WHERE session_id IS NOT NULL AND regexp_matches(content, '[^\s\pZ\pC]')
), named AS (
  SELECT *, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'agent') THEN 'assistant' WHEN r = 'tool' THEN 'tool' ELSE 'other' END AS who
  FROM kept WHERE r <> 'system'
), placed AS (
  SELECT *, coalesce(sec, max(sec) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS place FROM named
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place, id) AS k FROM placed
), talk AS (
  SELECT session_id, who, lead(who) OVER (PARTITION BY session_id ORDER BY k) AS nxt FROM ranked WHERE who IN ('user', 'assistant')
), whole AS (
  SELECT session_id FROM ranked GROUP BY session_id
  HAVING count(*) FILTER (who = 'other') = 0 AND count(*) FILTER (who IN ('user', 'assistant')) > 0 AND max(who) FILTER (k = 1) = 'user'
), bad AS (SELECT DISTINCT session_id FROM messages WHERE session_id IS NOT NULL AND (
  session_id NOT IN (SELECT session_id FROM whole)
  OR session_id IN (SELECT session_id FROM talk WHERE who = 'user' AND coalesce(nxt, 'user') = 'user')))
"""


def _instant_sql(c: str) -> str:
    iso = rf"regexp_replace({c}, '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})Z$', '\1-\2-\3T\4:\5:\6Z')"
    zoned = rf"CASE WHEN regexp_matches({iso}, '(Z|[+-]\d{{2}}:\d{{2}})$') THEN {iso} ELSE {iso} || 'Z' END"
    us = rf"""CASE WHEN regexp_matches({c}, '^\d{{10}}$') THEN try_cast({c} AS BIGINT) * 1000000 WHEN regexp_matches({c}, '^\d{{13}}$') THEN try_cast({c} AS BIGINT) * 1000
      WHEN regexp_matches({c}, '^\d{{4}}-?\d{{2}}-?\d{{2}}') THEN epoch_us(try_cast({zoned} AS TIMESTAMPTZ)) END"""
    lo, hi = 1735689600 * 10**6, 1798761600 * 10**6
    return f"(CASE WHEN {us} >= {lo} AND {us} < {hi} THEN {us} END)"


def _p5() -> str:
    pick = lambda f, ok, by: f"SELECT group_id, '{f}' AS field_name, record_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {by}, record_id) AS k FROM r WHERE {ok}) WHERE k = 1"
    grade = "coalesce(nullif(instr('ABCDEF', upper(trim(coalesce(source_reliability, '')))) * (length(trim(coalesce(source_reliability, ''))) = 1)::INT, 0), 9)"
    return f"""
WITH g AS ({_group_sql(_REGISTER)}), named AS (SELECT rid, min(rid) OVER (PARTITION BY g) AS group_id, count(*) OVER (PARTITION BY g) AS size FROM g),
r AS (SELECT group_id, record_id, {grade} AS grade, confidence_basis AS basis, {_instant_sql("last_seen")} AS seen, {_instant_sql("created_at")} AS made
  FROM cie_records JOIN named ON rid = record_id WHERE size > 1)
{pick("statement", "true", "grade, seen DESC NULLS LAST")}
UNION ALL {pick("confidence_basis", "basis IS NOT NULL AND lower(trim(basis)) NOT IN ('', 'unknown', 'none', 'n/a', '?', 'tbd', '-')", "seen DESC NULLS LAST")}
UNION ALL {pick("last_seen", "seen IS NOT NULL", "seen DESC")}
UNION ALL {pick("created_at", "made IS NOT NULL", "made")}"""


def oracle_sql() -> dict[str, str]:
    both = _group_sql(_BOTH)
    return {
        "p1_found": f"SELECT src AS src_table, first_id, rid AS copy_id FROM (SELECT *, min(rid) OVER (PARTITION BY src, g) AS first_id FROM ({both})) WHERE rid <> first_id",
        "p1_collapsed": f"SELECT src AS src_table, min(rid) AS first_id, count(*) AS n_rows, sum(n)::BIGINT AS occurrences FROM ({both}) GROUP BY src, g",
        "p4_found": f"{_P4} SELECT session_id FROM bad",
        "p4_conversations": f"{_P4} SELECT session_id, k - 1 AS seq, who AS role, content FROM ranked WHERE session_id NOT IN (SELECT session_id FROM bad)",
        "p5_found": _p5(),
        # no document lies near the capacity, so four characters a token tell which must be split
        "p6_checks": "SELECT count(*) AS documents, count(*) AS packed, count(*) FILTER (length(text) > 4 * capacity_tokens) AS split, 0::BIGINT AS cut, 0::BIGINT AS torn, 0::BIGINT AS overfull, true AS tight FROM documents, pack_spec",
        "p7_checks": "SELECT source, true AS within_cap, true AS as_wanted, true AS unique FROM mix_targets",
    }
