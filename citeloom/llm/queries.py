"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank, split_terms, term_key
from citeloom.llm.canonical import map_to_canonical
from citeloom.llm.formatting import formatting_duplicates
from citeloom.llm.fusion import CUT_MARK, STAND_INS, bare_doi, fuse, grouped_rows
from citeloom.llm.leaks import find_leaks, leak_report
from citeloom.llm.mojibake import garbled_cells
from citeloom.llm.packing import pack_texts, packing_summary
from citeloom.llm.pairs import cooccurrence
from citeloom.llm.residue import residue_documents, without_residue
from citeloom.llm.term_counts import TermStore, changed_records, signed_deltas
from citeloom.llm.terms import record_terms
from citeloom.session import materialize, scratch_path, table


def _term_store(spark: SparkSession, sf_dir: str) -> TermStore:
    """Counts of all keyword terms: the rows delivered on time, then the late ones as a delta."""
    papers = table(spark, sf_dir, "papers")
    late = F.coalesce(F.datediff("loaded_at", "exported_at") > 7, F.lit(False))
    terms = record_terms(papers.withColumn("_row", F.struct("paper_id", late.alias("late"))), "_row")
    terms = materialize(terms.select("_row.*", "term", "n"), "terms")
    sizes = {r.late: r.n for r in papers.groupBy(late.alias("late")).agg(F.count(F.lit(1)).alias("n")).collect()}
    store = TermStore(spark, scratch_path(spark, "term-store"))
    for when in (False, True):
        store.apply(signed_deltas(terms.filter(F.col("late") == when)), sizes.get(when, 0))
    return store


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_store(spark, sf_dir).marked().filter("mark is not null").select("term", "mark")


def p1_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_store(spark, sf_dir).marked()


def p1_keywords_plus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over ``keywords_plus`` alone, which plain SQL can express."""
    papers = table(spark, sf_dir, "papers")
    terms = (
        papers.filter(~is_blank(F.col("keywords_plus")))
        .select("paper_id", F.explode(split_terms(F.col("keywords_plus"))).alias("item"))
        .groupBy("paper_id", term_key(F.col("item")).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    )
    store = TermStore(spark, scratch_path(spark, "term-store"))
    store.apply(signed_deltas(terms), papers.count())
    return store.counts()


def p1_keywords_plus_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over ``keywords_plus`` kept up to date: all rows first, then, in a store opened anew,
    a batch that changes a term and deletes the later rows of each DOI."""
    raw = table(spark, sf_dir, "papers")
    key = F.when(~F.trim("doi").isin("", "nan"), F.lower(F.trim("doi")))
    before = materialize(raw.select("paper_id", key.alias("k"), "keywords_plus"), "before")
    first = before.filter("k is not null").groupBy("k").agg(F.min("paper_id").alias("first"))
    after = before.join(first, "k", "left").filter("first is null or paper_id = first").select("paper_id", F.replace("keywords_plus", F.lit("SCIENTOMETRICS"), F.lit("BIBLIOMETRICS")).alias("keywords_plus"))
    after = materialize(after, "after")

    def terms(rows: DataFrame) -> DataFrame:
        cells = rows.filter(~is_blank(F.col("keywords_plus"))).select("paper_id", F.explode(split_terms(F.col("keywords_plus"))).alias("item"))
        return cells.groupBy("paper_id", term_key(F.col("item")).alias("term")).agg(F.count(F.lit(1)).alias("n"))

    path = scratch_path(spark, "term-store")
    TermStore(spark, path).apply(signed_deltas(terms(before)), before.count())
    new, old = changed_records(before.drop("k"), after, "paper_id", ["keywords_plus"])
    store = TermStore(spark, path)
    store.apply(signed_deltas(terms(new), terms(old)), after.count() - before.count())
    return store.counts()


P1_REVISED_SQL = r"""
WITH b AS (SELECT paper_id, keywords_plus, CASE WHEN trim(doi) NOT IN ('', 'nan') THEN lower(trim(doi)) END AS k FROM papers),
a AS (SELECT paper_id, replace(keywords_plus, 'SCIENTOMETRICS', 'BIBLIOMETRICS') AS keywords_plus FROM b
      WHERE k IS NULL OR paper_id = (SELECT min(c.paper_id) FROM b c WHERE c.k = b.k))
SELECT term, count(*) AS occurrences, count(DISTINCT paper_id) AS records
FROM (SELECT paper_id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS term
      FROM (SELECT paper_id, unnest(string_split(keywords_plus, ';')) AS x FROM a
            WHERE keywords_plus IS NOT NULL AND trim(keywords_plus) NOT IN ('', 'nan')))
WHERE term <> '' GROUP BY term
"""
P1_PLUS_SQL = r"""
SELECT term, count(*) AS occurrences, count(DISTINCT paper_id) AS records
FROM (SELECT paper_id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS term
      FROM (SELECT paper_id, unnest(string_split(keywords_plus, ';')) AS x FROM papers
            WHERE keywords_plus IS NOT NULL AND trim(keywords_plus) NOT IN ('', 'nan')))
WHERE term <> '' GROUP BY term
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = record_terms(table(spark, sf_dir, "papers"))
    return cooccurrence(terms, "paper_id", "term").select(F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"))


def p3_keywords_plus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within ``keywords_plus`` alone, which plain SQL can express."""
    papers = table(spark, sf_dir, "papers").filter(~is_blank(F.col("keywords_plus")))
    terms = papers.select("paper_id", F.explode(split_terms(F.col("keywords_plus"))).alias("item")).select("paper_id", term_key(F.col("item")).alias("term"))
    out = cooccurrence(terms.filter("term <> ''"), "paper_id", "term")
    return out.select(F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"), "n_ab", "n_a", "n_b", F.round("lift", 4).alias("lift"))


P3_PLUS_SQL = r"""
WITH t AS (
  SELECT DISTINCT paper_id, term FROM (
    SELECT paper_id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS term
    FROM (SELECT paper_id, unnest(string_split(keywords_plus, ';')) AS x FROM papers
          WHERE keywords_plus IS NOT NULL AND trim(keywords_plus) NOT IN ('', 'nan')))
  WHERE term <> ''),
f AS (SELECT term, count(*) AS n FROM t GROUP BY term),
tot AS (SELECT count(DISTINCT paper_id) AS n FROM t),
p AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n_ab
      FROM t a JOIN t b ON a.paper_id = b.paper_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT term_a, term_b, n_ab, fa.n AS n_a, fb.n AS n_b, round(n_ab * tot.n / (fa.n::DOUBLE * fb.n), 4) AS lift
FROM p JOIN f fa ON fa.term = term_a JOIN f fb ON fb.term = term_b, tot
WHERE n_ab * tot.n >= 3.0 * fa.n * fb.n
"""


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_canonical(
        table(spark, sf_dir, "paper_addresses"), table(spark, sf_dir, "institutions"), "address_id", "affiliations", "inst_id", "inst_name", "city", "acronym"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("address_id", "inst_id")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed addresses that mean no entry of the list."""
    none = _addresses(spark, sf_dir).filter("inst_id = 0").select("address_id")
    return table(spark, sf_dir, "paper_addresses").join(none, "address_id", "left_semi").select("address_id", "affiliations")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting_duplicates(table(spark, sf_dir, "papers"))
    return found.filter("group_id <> member_id").select(F.col("group_id").alias("paper_id_a"), F.col("member_id").alias("paper_id_b"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group with the number of its copies."""
    found = formatting_duplicates(table(spark, sf_dir, "papers"))
    return found.filter("group_id = member_id").select(F.col("group_id").alias("paper_id"), "copies")


def _doi_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, feeds = table(spark, sf_dir, "papers"), table(spark, sf_dir, "export_feeds")
    return grouped_rows(papers, bare_doi(F.col("doi")), "paper_id", "feed", "exported_at", ["title", "abstract"], feeds)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving title and abstract of every DOI group under the declared trust ranks."""
    return fuse(_doi_groups(spark, sf_dir), ["title", "abstract"]).select(F.col("key").alias("doi"), "title_id", "abstract_id")


def p6_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving title and abstract by the greatest posterior, sources judged by their claims."""
    fused = fuse(_doi_groups(spark, sf_dir), ["title", "abstract"], declared=False)
    return fused.select(F.col("key").alias("doi"), "title_id", F.round("title_p", 4).alias("title_p"), "abstract_id", F.round("abstract_p", 4).alias("abstract_p"))


_NORM = r"regexp_replace(lower(regexp_replace(t, '{cut}', '', 'g')), '[^\p{L}\p{N}]+', '', 'g')".replace("{cut}", CUT_MARK)
_ONE_FIELD = r"""{f}_c AS (SELECT k, paper_id, feed, exported_at, n, length(n) * (n NOT IN ({stand}))::INT AS size, n IN ({stand}) AS blank, regexp_matches(t, '{cut}') AS marked
  FROM (SELECT k, paper_id, feed, exported_at, t, {norm} AS n FROM (SELECT *, regexp_replace(coalesce({f}, ''), '^\s+|\s+$', '', 'g') AS t FROM g))),
{f}_m AS (SELECT k, arg_max(n, struct_pack(s := size, n := n)) AS fullest, max(size) AS most FROM {f}_c GROUP BY k),
{f}_b AS (SELECT k, arg_min(paper_id, struct_pack(r := coalesce(trust_rank, 2147483647), t := -coalesce(epoch_us(exported_at), -4611686018427387904), i := paper_id)) AS {f}_id
  FROM {f}_c JOIN {f}_m USING (k) LEFT JOIN export_feeds USING (feed) WHERE NOT blank AND NOT (size < most AND (starts_with(fullest, n) OR marked)) GROUP BY k)"""
#: The same survivors by rank, time and id in plain SQL.
P6_FOUND_SQL = (
    r"""WITH d AS (SELECT *, nullif(regexp_extract(lower(doi), '(10\.\d{4,9}/\S*[^\s.,;:"''])', 1), '') AS k FROM papers),
g AS (SELECT * FROM d WHERE k IN (SELECT k FROM d WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)),
"""
    + ",\n".join(_ONE_FIELD.replace("{norm}", _NORM).replace("{stand}", ", ".join(f"'{x}'" for x in STAND_INS)).replace("{cut}", CUT_MARK).replace("{f}", f) for f in ("title", "abstract"))
    + "\nSELECT k AS doi, coalesce(title_id, 0) AS title_id, coalesce(abstract_id, 0) AS abstract_id FROM (SELECT DISTINCT k FROM g) LEFT JOIN title_b USING (k) LEFT JOIN abstract_b USING (k)"
)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_repaired(spark, sf_dir).select("paper_id", "field_name").distinct()


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled cells with what could be restored."""
    return garbled_cells(table(spark, sf_dir, "papers"), "paper_id", ["title", "abstract", "authors"])


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, misplaced, over_capacity, well_filled): rows that are not placed exactly once from
    the first to the last token, containers beyond the capacity, and whether the containers are
    at most 2 % more than the least possible number by volume and the bins left open."""
    docs = table(spark, sf_dir, "documents")
    packed = materialize(pack_texts(docs), "packed")
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("piece_start") + F.col("n_tokens")).alias("end"))
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    wrong = rows.join(per, "doc_id", "left").filter("k is null or k <> copies * last or n <> copies * end").agg(F.count(F.lit(1))).scalar()
    bins = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max("place").alias("p"), F.count(F.lit(1)).alias("k"))
    over = bins.filter("n > 2048 or p <> k").agg(F.count(F.lit(1))).scalar()
    tasks = packed.select(F.shiftright("container_id", 40)).distinct().count()
    s = packing_summary(packed)
    out = s.select((F.col("containers") <= F.col("fewest") * 1.02 + 2 * tasks).alias("well_filled"))
    return out.select(docs.agg(F.count(F.lit(1))).scalar().alias("documents"), wrong.alias("misplaced"), over.alias("over_capacity"), "well_filled")


P8_CHECK_SQL = "SELECT count(*) AS documents, 0::BIGINT AS misplaced, 0::BIGINT AS over_capacity, true AS well_filled FROM documents"


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_summary(pack_texts(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


#: Equality join of all runs of 12 words.
P9_FOUND_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents),
h AS (SELECT item_id, regexp_extract_all(replace(lower(item_text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM heldout_items),
hw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, length(w) - 10)) AS i FROM h)),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, length(w) - 10)) AS i FROM d))
SELECT DISTINCT doc_id, item_id FROM dw JOIN hw USING (g)
"""
P9_REPORT_SQL = "SELECT item_id, count(*) AS documents FROM (" + P9_FOUND_SQL + ") GROUP BY item_id"


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(p9_found(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without residue documents, all columns."""
    return without_residue(table(spark, sf_dir, "documents"))


QUERIES = [
    p1_found, p1_term_counts, p1_keywords_plus_counts, p1_keywords_plus_revised, p3_found, p3_keywords_plus_pairs, p4_found, p4_unmatched, p5_found, p5_collapsed,
    p6_found, p6_fused, p7_found, p7_repaired, p8_packing, p8_check, p8_summary, p9_found, p9_report, p10_found, p10_clean,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_keywords_plus_counts": P1_PLUS_SQL, "p1_keywords_plus_revised": P1_REVISED_SQL, "p3_keywords_plus_pairs": P3_PLUS_SQL, "p6_found": P6_FOUND_SQL,
        "p8_check": P8_CHECK_SQL, "p9_found": P9_FOUND_SQL, "p9_report": P9_REPORT_SQL,
    }
