"""Free-entered values to a canonical list: partition-based pigeonhole join, SQL only.

Typed values and references are folded (case, accents, separators), abbreviations and foreign
words are written out, and both are compared as strings without spaces. Equal strings match
at once. For the rest, each reference string is cut into k + 1 segments; a string within k
edits holds one of them unchanged near its place, so an equality join on (reference length,
segment number, substring) finds every candidate. The built-in levenshtein confirms each
candidate right after the join, before anything is shuffled, so a segment that stands in many
values (a generic word) costs comparisons but no exchange. An anti-join reports the values
without a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import materialize

# Letters with marks and their plain forms.
MARKED = "àáâãäåāăąçćčďđèéêëēęěìíîïīłľñńňòóôõöøōőŕřśšşťţùúûüūůűýÿźżžğı"
PLAIN = "aaaaaaaaacccddeeeeeeeiiiiillnnnoooooooorrsssttuuuuuuuyyzzzgi"
# Abbreviations and foreign words of institution names; an empty word is dropped.
WORDS = {
    "univ": "university", "uni": "university", "universitat": "university", "universite": "university", "universidad": "university",
    "universidade": "university", "universita": "university", "uniwersytet": "university", "univers": "university",
    "inst": "institute", "institut": "institute", "instituto": "institute", "acad": "academy", "academia": "academy", "akademie": "academy",
    "natl": "national", "nat": "national", "ctr": "centre", "center": "centre", "hosp": "hospital", "hopital": "hospital", "gen": "general",
    "tech": "technical", "technische": "technical", "tecnica": "technical", "technique": "technical", "tu": "technical university",
    "med": "medical", "medizinische": "medical", "medecine": "medical", "polytech": "polytechnic", "politecnico": "polytechnic",
    "polytechnique": "polytechnic", "sci": "science", "phys": "physics", "biol": "biology", "stud": "studies", "res": "research",
    "publ": "public", "hlth": "health", "staatliche": "state", "soc": "social", "polym": "polymer",
    "of": "", "for": "", "the": "", "de": "", "du": "", "di": "", "degli": "", "studi": "", "ecole": "", "d": "", "la": "", "and": "",
}
# The usual short forms of the words of institution names.
SHORT = {
    "university": "univ", "institute": "inst", "academy": "acad", "national": "natl", "centre": "ctr", "hospital": "hosp", "technical": "tech",
    "medical": "med", "polytechnic": "polytech", "science": "sci", "physics": "phys", "biology": "biol", "studies": "stud", "research": "res",
    "public": "publ", "health": "hlth",
}


def folded(c: Column) -> Column:
    """Lower case without accents; no-break spaces and underscores as spaces."""
    c = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), r"[ _]", " ")


def _mapping(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")


def written_out(c: Column, words_table: dict[str, str]) -> Column:
    """Words of a folded text with abbreviations written out and fillers dropped, no spaces."""
    table = _mapping(words_table)
    words = F.split(F.trim(F.regexp_replace(c, r"[^a-z]+", " ")), " ")
    return F.regexp_replace(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), ""), " ", "")


def reference_forms(refs: DataFrame, id_col: str, name: str, place: str, acronym: str | None, words_table: dict[str, str] = WORDS, short_table: dict[str, str] = SHORT) -> DataFrame:
    """(rid, form, kind): strings that stand for a reference entry.

    The name itself, the name written out, and its words before and after the place name.
    """
    r = refs.select(
        F.col(id_col).alias("rid"), folded(F.col(name)).alias("n"), folded(F.col(place)).alias("p"), *([folded(F.col(acronym)).alias("a")] if acronym else [])
    ).filter("rid is not null and n is not null")
    rest = F.when(F.col("p").isNull() | (F.col("p") == ""), F.col("n")).otherwise(F.replace(F.col("n"), F.col("p"), F.lit(" ")))
    r = r.withColumn("rest", F.regexp_replace(F.trim(F.regexp_replace(rest, r"[^a-z]+", " ")), r"\b(of|for|the)\b ?", ""))
    r = r.withColumn("kind", F.array_join(F.split("rest", " "), "")).withColumn("city", F.regexp_replace(F.coalesce("p", F.lit("")), r"[^a-z]+", ""))
    words = F.split("rest", " ")
    back = F.when(F.size(words) == 2, F.concat(words[1], words[0])).otherwise(F.col("kind"))
    short = _mapping(short_table)
    whole = F.split(F.trim(F.regexp_replace("n", r"[^a-z]+", " ")), " ")
    shorten = lambda a: F.array_join(F.transform(a, lambda w: F.coalesce(F.try_element_at(short, w), w)), "")
    brief, brief_full = shorten(F.filter(whole, lambda w: ~w.isin("of", "for", "the"))), shorten(whole)
    forms = F.array_distinct(
        F.array(
            brief, brief_full,
            F.regexp_replace("n", r"[^a-z]+", ""), written_out(F.col("n"), words_table), F.concat("city", "kind"), F.concat("kind", "city"),
            F.concat(back, F.col("city")), F.concat(F.col("city"), back),
        )
    )
    out = r.select("rid", F.explode(forms).alias("form"), F.lit("name").alias("kind"))
    if acronym:
        out = out.unionByName(r.filter("a is not null").select("rid", F.regexp_replace("a", r"[^a-z0-9]+", "").alias("form"), F.lit("acronym").alias("kind")))
    return out.filter("form <> ''").distinct()


def typed_keys(typed: DataFrame, id_col: str, value: str, name_words: int, words_table: dict[str, str] = WORDS) -> DataFrame:
    """(tid, key, raw): candidate strings of each typed value.

    Names bracketed before a value are removed. Pieces are taken between commas, slashes,
    semicolons, dashes and line breaks, whole and at double spaces; text in parentheses is a
    piece of its own.
    """
    base = typed.select(F.col(id_col).alias("tid"), F.regexp_replace(folded(F.col(value)), r"^\s*\[[^\]]*\]", "").alias("v")).filter("tid is not null")
    base = base.withColumn("inner", F.expr(r"regexp_extract_all(v, '\\(([^()]*)\\)', 1)")).withColumn("v", F.regexp_replace("v", r"\([^()]*\)", " "))
    hard = F.split("v", r"[,/;|\n\t•]|\s[-–]\s")
    soft = F.split("v", r"[,/;|\n\t•]|\s[-–]\s|\s{2,}")
    dotted = F.split(F.regexp_replace("v", r"(?<=[a-z]{2})\.(?=[a-z]{2})", " "), r"[,/;|\n\t•]|\s[-–]\s")
    # words set apart by double spaces: runs of neighbouring pieces, no longer than a name
    runs = F.flatten(
        F.transform(soft, lambda _x, i: F.transform(F.sequence(F.lit(2), F.lit(name_words)), lambda n: F.array_join(F.slice(soft, i + 1, n), " ")))
    )
    runs = F.when(F.col("v").rlike(r"\S\s{2,}\S.*\S\s{2,}\S"), runs).otherwise(F.array().cast("array<string>"))
    pieces = base.select("tid", F.explode(F.array_distinct(F.concat(hard, soft, dotted, "inner", runs))).alias("x"))
    raw = F.regexp_replace("x", r"[^a-z]+", "")
    return pieces.select("tid", F.explode(F.array_distinct(F.array(raw, written_out(F.col("x"), words_table)))).alias("key")).filter("length(key) > 1").distinct()


def segments(forms: DataFrame, k: int) -> DataFrame:
    """(form, L, i, seg): each form of length L cut into k + 1 segments, the last ones longer."""
    size = F.length("form")
    f = forms.select("form").distinct().filter(size > k).withColumn("L", size).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k))))
    b, x = F.floor(F.col("L") / (k + 1)).cast("int"), F.lit(k + 1) - (F.col("L") - F.floor(F.col("L") / (k + 1)) * (k + 1))
    start = (F.col("i") * b + F.greatest(F.lit(0), F.col("i") - x)).cast("int")
    length = (b + F.when(F.col("i") >= x, 1).otherwise(0)).cast("int")
    return f.withColumn("start", start).withColumn("len", length).withColumn("seg", F.expr("substring(form, start + 1, len)"))


def probes(keys: DataFrame, shapes: DataFrame, k: int) -> DataFrame:
    """(key, L, i, seg): the substrings of each key that may equal a segment.

    For length difference d the i-th segment can have moved by at most min(i, k - i) around
    both ends (multi-match bounds).
    """
    lengths = F.explode(F.sequence(F.length("key") - k, F.length("key") + k))
    q = keys.select("key", F.length("key").alias("n"), lengths.alias("L")).join(shapes, "L")
    d = F.col("n") - F.col("L")
    lo = F.greatest(-F.col("i"), d - (F.lit(k) - F.col("i")))
    hi = F.least(F.col("i"), d + (F.lit(k) - F.col("i")))
    q = q.withColumn("lo", F.greatest(lo, -F.col("start"))).withColumn("hi", F.least(hi, F.col("n") - F.col("len") - F.col("start"))).filter("lo <= hi")
    q = q.withColumn("s", F.explode(F.sequence("lo", "hi")))
    return q.select("key", "L", "i", F.expr("substring(key, start + s + 1, len)").alias("seg"))


def map_to_canonical(
    typed: DataFrame, refs: DataFrame, id_col: str, value: str, ref_id: str, ref_name: str, ref_place: str, ref_acronym: str | None = None, k: int = 4,
    words_table: dict[str, str] = WORDS, short_table: dict[str, str] = SHORT,
) -> DataFrame:
    """(``id_col``, ``ref_id``, distance): the entry each typed value means, 0 for none.

    Values that are null or blank give no row. ``k`` is the greatest number of edits; more than
    2 are accepted only if the letters agree but for 2 (swapped neighbours count twice). Of
    several entries the one at the least distance is taken; entries that tie are told apart by a
    whole piece before an acronym and then by the smaller id. Repeated rows give one row per id.
    ``words_table`` and ``short_table`` hold abbreviations with their long and words with their
    short forms; either may be empty.
    """
    forms = materialize(reference_forms(refs, ref_id, ref_name, ref_place, ref_acronym, words_table, short_table), "forms")
    typed = typed.filter(F.col(value).isNotNull() & (F.regexp_replace(value, r"(?U)\s+", "") != ""))
    longest = refs.agg(F.max(F.size(F.split(F.trim(F.col(ref_name)), r"\s+")))).collect()[0][0] or 0  # words of the longest name
    keys = materialize(typed_keys(typed, id_col, value, max(longest, 2), words_table), "keys")
    once = materialize(keys.select("key").distinct(), "distinct-keys")
    exact = once.join(forms, once.key == forms.form).select("key", "rid", F.when(F.col("kind") == "name", 0).otherwise(1).alias("how"), F.lit(0).alias("distance"))
    exact = materialize(exact.distinct(), "exact")
    names = forms.filter("kind = 'name'")
    segs = materialize(segments(names, k), "segments")
    shapes = segs.select("L", "i", "start", "len").distinct()  # at most (k + 1) rows per length
    rest = once.join(exact.select("key"), "key", "left_anti")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    near = probes(rest, shapes, k).join(segs.select("form", "L", "i", "seg"), ["L", "i", "seg"])
    near = near.withColumn("distance", F.levenshtein("key", "form", k)).filter("distance >= 0")
    near = near.filter((F.col("distance") <= 2) | (F.levenshtein(letters("key"), letters("form")) <= 2)).select("key", "form", "distance").distinct()
    near = near.join(names, "form").select("key", "rid", F.lit(0).alias("how"), "distance")
    hits = exact.unionByName(near.distinct())
    best = materialize(keys.join(hits, "key").groupBy("tid").agg(F.min(F.struct("how", "distance", "rid")).alias("m")), "best").select("tid", F.col("m.rid").alias("rid"), F.col("m.distance").alias("distance"))
    ids = typed.select(F.col(id_col).alias("tid")).filter("tid is not null").distinct()
    none = ids.join(best, "tid", "left_anti").select("tid", F.lit(0).cast(refs.schema[ref_id].dataType).alias("rid"), F.lit(None).cast("int").alias("distance"))
    return best.unionByName(none).select(F.col("tid").alias(id_col), F.col("rid").alias(ref_id), "distance")
