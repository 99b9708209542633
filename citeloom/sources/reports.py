"""Snapshots, short reports and bundles built from small aggregates.

Only bounded tables come to the driver: top lists, one row per year, one row per field.
"""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import citations as C
from citeloom.operators import frequency as Q
from citeloom.operators import networks as N
from citeloom.operators import structure as S
from citeloom.operators import temporal as T
from citeloom.sources.export import Corpus, report, snapshot


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def case_snapshot(corpus: Corpus, top_n: int = 10, parameters: dict | None = None) -> dict:
    """Size, coverage and the top lists of a corpus."""
    doc = snapshot(corpus, parameters)
    doc["top_journals"] = _rows(Q.top_k(Q.frequency(corpus.papers.filter("journal is not null"), "journal"), "journal", top_n))
    if corpus.has("keywords"):
        doc["top_keywords"] = _rows(Q.top_k(Q.frequency(corpus.keywords, "keyword"), "keyword", top_n))
        doc["top_pairs"] = _rows(N.pair_counts(corpus.keywords, "keyword", min_weight=2).orderBy(F.desc("weight"), "a", "b").limit(top_n))
    return doc


def innovation_snapshot(corpus: Corpus, top_n: int = 30, min_shared: int = 2, top_k: int = 5) -> dict:
    """Coupling, brokerage, baselines, robustness and disruption of a corpus."""
    doc: dict = {}
    if corpus.has("references"):
        nodes, edges = N.coupling_network(corpus.references, top_n, min_shared)
        holes = S.structural_holes(nodes, edges, "rec_id", "strength")
        doc["coupled_papers"] = _rows(nodes)
        doc["coupling_pairs"] = _rows(edges.orderBy(F.desc("weight"), "a", "b").limit(20))
        doc["brokers"] = _rows(holes.orderBy(F.desc("brokerage_score"), "node").limit(top_k))
        doc["baselines"] = _rows(S.brokerage_baselines(holes, top_k))
        doc["robustness"] = _rows(S.brokerage_robustness(corpus.references, sorted({max(5, top_n // 2), top_n}), sorted({min_shared, min_shared + 1}), top_k_brokers=top_k))
    if corpus.has("citations"):
        di = C.disruption(corpus.papers, corpus.citations)
        doc["disruption"] = _rows(C.disruption_summary(di))
        doc["disruptive"] = _rows(C.disruption_extremes(di, top_n=top_k, min_support=1))
        doc["consolidating"] = _rows(C.disruption_extremes(di, "consolidating", top_n=top_k, min_support=1))
    return doc


def stable_brokers(robustness: DataFrame, least: float = 0.6) -> DataFrame:
    """(broker, scenarios, share): brokers that stand in at least a share of the scenarios."""
    n = robustness.agg(F.count(F.lit(1))).scalar()
    each = robustness.select(F.explode(F.split("brokers", "; ")).alias("broker")).filter("broker <> ''")
    out = each.groupBy("broker").agg(F.count(F.lit(1)).alias("scenarios")).withColumn("share", F.round(F.col("scenarios") / n, 4))
    return out.filter(F.col("share") >= least)


def forward_signals(corpus: Corpus) -> list[str]:
    """One sentence each on publications, keywords, leadership and themes, where the data allow."""
    out = []
    fc = _rows(T.publication_forecast(corpus.papers).orderBy("year"))
    ahead = [r for r in fc if r["series"] == "Forecast"]
    if ahead:
        last = [r for r in fc if r["series"] == "Actual"][-1]
        word = "grow" if ahead[0]["publications"] >= last["publications"] else "fall"
        out.append(f"Publications: {last['publications']:.0f} in {last['year']}, expected to {word} to {ahead[0]['publications']:.1f} next year and {ahead[-1]['publications']:.1f} by {ahead[-1]['year']}.")
    if corpus.has("keywords"):
        by: dict[str, list[str]] = {}
        for r in _rows(T.opportunity_map(corpus.keywords, corpus.papers).orderBy(F.desc("growth"), "keyword")):
            by.setdefault(r["signal"], []).append(r["keyword"])
        out += [f"{k}: {', '.join(v[:2])}." for k, v in sorted(by.items()) if k != "Niche / Weakening"]
        chains = _rows(S.theme_chains(S.period_topics(corpus.keywords, corpus.papers))[0].orderBy(F.desc("projected_next"), "chain").limit(3))
        out += [f"Theme {r['theme']}: {r['signal'].lower()}, weight {r['latest_weight']} with {r['growth']:+.1f} % in its latest slice." for r in chains]
    if corpus.has("countries"):
        lead = _rows(T.leadership_shift(corpus.countries, corpus.papers, "country").limit(3))
        out += [f"{r['country']}: {r['signal'].lower()} ({r['share_shift']:+.2f} points of all papers)." for r in lead]
    return out


def changed_parameters(parameters: dict[str, dict]) -> list[dict]:
    """Parameters that differ from their default, by group: {name: {group, value, default}}."""
    groups: dict[str, list[tuple[str, dict]]] = {}
    for name, p in sorted(parameters.items()):
        if p.get("value") != p.get("default"):
            groups.setdefault(p.get("group", "Other"), []).append((name, p))
    return [
        {"group": g, "count": len(v), "current": "; ".join(f"{n}={p['value']}" for n, p in v), "default": "; ".join(f"{n}={p.get('default')}" for n, p in v)} for g, v in sorted(groups.items())
    ]


def table_markdown(rows: list[dict]) -> str:
    if not rows:
        return "No rows.\n"
    heads = list(rows[0])
    lines = ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
    return "\n".join(lines + ["| " + " | ".join(str(r.get(h, "")) for h in heads) + " |" for r in rows]) + "\n"


def document(title: str, doc: dict) -> str:
    """A snapshot of lists and values as Markdown."""
    parts = [f"# {title}", ""]
    for k, v in doc.items():
        parts.append(f"## {k.replace('_', ' ').capitalize()}\n")
        parts.append(table_markdown(v) if isinstance(v, list) and v and isinstance(v[0], dict) else f"{json.dumps(v, ensure_ascii=False, default=str)}\n")
    return "\n".join(parts)


def bundle(corpus: Corpus, parameters: dict[str, dict] | None = None) -> bytes:
    """Reports and snapshots of a corpus in one archive, with an index."""
    case = case_snapshot(corpus)
    innovation = innovation_snapshot(corpus)
    signals = forward_signals(corpus)
    files = {
        "case.md": report(case), "case.json": json.dumps(case, indent=2, default=str, ensure_ascii=False), "innovation.md": document("Innovation metrics", innovation),
        "innovation.json": json.dumps(innovation, indent=2, default=str, ensure_ascii=False), "signals.md": "# Forward signals\n\n" + "\n".join(f"- {s}" for s in signals) + "\n",
        "parameters.md": "# Changed parameters\n\n" + table_markdown(changed_parameters(parameters or {})),
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
        z.writestr("index.json", json.dumps(sorted(files), indent=2))
    return buffer.getvalue()


def entity_signals(summary: DataFrame, label: str, top_n: int = 5) -> dict[str, list[str]]:
    """leading, rising and cooling entities among the first ``top_n`` of an entity forecast."""
    rows = _rows(summary.orderBy(F.desc("projected_growth"), F.desc("projected_next"), F.desc("total"), label).limit(top_n))
    names = [r[label] for r in rows]
    return {"leading": names[:2], "rising": [r[label] for r in rows if r["projected_growth"] > 0][:2], "cooling": [r[label] for r in rows if r["projected_growth"] < 0][:1]}
