"""Tables, snapshots and bundles as files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import bursts as B
from citeloom.operators import citations as C
from citeloom.operators import frequency as Q
from citeloom.operators import networks as N
from citeloom.operators import structure as S
from citeloom.operators import temporal as T
from citeloom.operators.records import coverage

BUNDLE_ROWS = 5_000


class Corpus:
    """Lazy long tables of a corpus: papers, keywords, authors, countries, references, citations."""

    def __init__(self, papers: DataFrame, **tables: DataFrame):
        self.papers = papers
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def has(self, *names: str) -> bool:
        return all(n in self.tables for n in names)


#: Tables of the bundle: name -> (long tables needed, builder).
TABLES: dict[str, tuple[tuple[str, ...], Callable[[Corpus], DataFrame]]] = {
    "descriptive/publications_by_year": ((), lambda c: Q.frequency(c.papers.filter("year is not null"), "year")),
    "descriptive/top_journals": ((), lambda c: Q.ranked_table(Q.frequency(c.papers.filter("journal is not null"), "journal"), "journal", 50)),
    "descriptive/annual_growth": ((), lambda c: Q.annual_growth(c.papers)),
    "descriptive/language": ((), lambda c: Q.single_value_frequency(c.papers, "language")),
    "descriptive/document_types": ((), lambda c: Q.single_value_frequency(c.papers, "doctype")),
    "descriptive/citations_by_year": ((), lambda c: Q.by_year(c.papers)),
    "descriptive/citation_histogram": ((), lambda c: Q.citation_histogram(c.papers)),
    "descriptive/highly_cited": ((), lambda c: Q.highly_cited(c.papers)),
    "descriptive/bradford_core": ((), lambda c: Q.bradford_core(Q.frequency(c.papers.filter("journal is not null"), "journal"))),
    "keywords/top_keywords": (("keywords",), lambda c: Q.top_k(Q.frequency(c.keywords, "keyword"), "keyword", 500)),
    "keywords/pairs": (("keywords",), lambda c: N.pair_counts(c.keywords, "keyword", min_weight=2).orderBy(F.desc("weight"), "a", "b").limit(500)),
    "keywords/jaccard": (("keywords",), lambda c: N.jaccard(c.keywords)),
    "keywords/heatmap": (("keywords",), lambda c: S.cluster_heatmap(c.keywords)),
    "keywords/thematic_map": (("keywords",), lambda c: S.thematic_map(c.keywords)),
    "keywords/bursts": (("keywords",), lambda c: B.keyword_bursts(c.keywords, c.papers)),
    "keywords/growth": (("keywords",), lambda c: T.keyword_growth(c.keywords, c.papers)),
    "keywords/opportunities": (("keywords",), lambda c: T.opportunity_map(c.keywords, c.papers)),
    "keywords/themes": (("keywords",), lambda c: S.theme_chains(S.period_topics(c.keywords, c.papers))[0]),
    "people/top_authors": (("authors",), lambda c: Q.ranked_table(Q.frequency(c.authors, "author"), "author", 50)),
    "people/lotka": (("authors",), lambda c: Q.lotka(c.authors)),
    "people/production": (("authors",), lambda c: Q.production_over_time(c.authors, c.papers)),
    "places/top_countries": (("countries",), lambda c: Q.ranked_table(Q.frequency(c.countries, "country"), "country", 50)),
    "places/quadrant": (("countries",), lambda c: N.impact_quadrant(c.countries, c.papers)),
    "places/leadership": (("countries",), lambda c: T.leadership_shift(c.countries, c.papers, "country")),
    "forecast/publications": ((), lambda c: T.publication_forecast(c.papers)),
    "forecast/journals": ((), lambda c: T.entity_forecast(c.papers.filter("journal is not null").select("rec_id", "journal"), c.papers, "journal")[0]),
    "references/top_references": (("references",), lambda c: Q.top_k(C.reference_frequency(c.references), "ref", 500)),
    "references/spectroscopy": (("references",), lambda c: C.rpys(c.references)),
    "references/peaks": (("references",), lambda c: C.rpys_peaks(c.references)),
    "references/bursts": (("references",), lambda c: B.reference_bursts(c.references, c.papers)),
    "references/cocitation": (("references",), lambda c: N.cocitation(c.references)[1]),
    "references/coupling": (("references",), lambda c: N.coupling_network(c.references)[1]),
    "innovation/disruption": (("citations",), lambda c: C.disruption_extremes(C.disruption(c.papers, c.citations), top_n=50)),
    "innovation/disruption_summary": (("citations",), lambda c: C.disruption_summary(C.disruption(c.papers, c.citations))),
    "innovation/structural_holes": (("references",), lambda c: S.structural_holes(*N.coupling_network(c.references), "rec_id", "strength")),
}


def available_tables(corpus: Corpus) -> dict[str, list[str]]:
    """Names of the tables a corpus allows, by group."""
    out: dict[str, list[str]] = {}
    for name, (needs, _) in TABLES.items():
        if corpus.has(*needs):
            group, item = name.split("/", 1)
            out.setdefault(group, []).append(item)
    return out


def safe_name(name: str) -> str:
    return re.sub(r"[^\w\-.]+", "_", name).strip("_")


def export_tables(corpus: Corpus, path: str, selected: list[str] | None = None) -> dict[str, str]:
    """Each table as a CSV folder under ``path``; returns name -> ``written``, ``skipped`` or the error.

    A folder has as many files as the table has tasks; small tables are joined into one by AQE.
    """
    status: dict[str, str] = {}
    for name, (needs, build) in TABLES.items():
        if selected is not None and name not in selected:
            continue
        if not corpus.has(*needs):
            status[name] = "skipped"
            continue
        try:
            build(corpus).write.mode("overwrite").option("header", True).csv(f"{path}/{safe_name(name)}")
            status[name] = "written"
        except Exception as e:  # noqa: BLE001 - one table must not stop the others
            status[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return status


def export_zip(corpus: Corpus, selected: list[str] | None = None, rows: int = BUNDLE_ROWS) -> bytes:
    """The tables as CSV files and a manifest in one archive.

    An archive is made by the driver, so it takes whole tables of at most ``rows`` rows; larger
    ones are named in the manifest as left out (``export_tables`` writes them).
    """
    buffer = io.BytesIO()
    names, left_out = [], []
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, (needs, build) in TABLES.items():
            if (selected is None or name in selected) and corpus.has(*needs):
                found = build(corpus).limit(rows + 1).toPandas()
                if len(found) > rows:
                    left_out.append(name)
                    continue
                z.writestr(f"{name}.csv", found.to_csv(index=False))
                names.append(name)
        z.writestr("manifest.json", json.dumps({"tables": names, "left_out": left_out, "row_limit": rows}, indent=2))
    return buffer.getvalue()


def snapshot(corpus: Corpus, parameters: dict | None = None, defaults: dict | None = None, fields: list[str] | None = None) -> dict:
    """Coverage, size and parameters (with a changed flag) of a corpus as one document."""
    first = corpus.papers.agg(F.count(F.lit(1)).alias("records"), F.min("year").alias("first"), F.max("year").alias("last"), F.countDistinct("journal").alias("journals")).first()
    cover = coverage(corpus.papers, fields or [c for c in corpus.papers.columns if c not in ("rec_id", "year", "times_cited")]).collect()  # one row per field
    scale = "small" if first.records < 100 else "medium" if first.records < 1000 else "large"
    params = parameters or {}
    return {
        "records": first.records, "years": [first.first, first.last], "journals": first.journals, "scale": scale,
        "coverage": {r.field: r.coverage for r in cover},
        "parameters": [{"name": k, "value": v, "changed": (defaults or {}).get(k, v) != v} for k, v in sorted(params.items())],
    }


def report(doc: dict) -> str:
    """A snapshot as Markdown."""
    lines = [
        "# Corpus report", "", f"- Records: {doc['records']} ({doc['scale']} corpus)", f"- Years: {doc['years'][0]} to {doc['years'][1]}", f"- Journals: {doc['journals']}", "",
        "## Field coverage", "", "| Field | Coverage |", "| --- | --- |", *[f"| {k} | {v:.2%} |" for k, v in doc["coverage"].items()], "",
        "## Parameters", "", *[f"- {p['name']} = {p['value']}" + (" (changed)" if p["changed"] else "") for p in doc["parameters"]],
    ]
    return "\n".join(lines)
