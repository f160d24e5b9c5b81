"""Samples to label, label sheets, validation and the long label table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.functions.arrays import as_boolean, as_whole_number
from litmill.functions.dates import era_of_sample
from litmill.functions.text import has_text
from litmill.schemas import conform
from litmill.session import expose_package
from litmill.sources.tables import upsert

#: The closed label vocabulary.
STUDY_DESIGNS = ["RCT", "cohort", "case_control", "case_series", "review", "other"]
EFFECTS = ["positive", "null", "negative", "mixed", "na"]
FIELDS = ["study_design", "sample_size", "has_control", "statistical_claim_present", "effect_direction", "coi_disclosed_in_abstract"]
ERAS = ["pre2000", "2000-2009", "2010-2019", "2020+"]


# Sampling


def allocate(counts: list[int], n: int) -> list[int]:
    """Seats by largest remainders, ties by count then place; no cell gets more than its count, and what that leaves
    goes one by one to cells with room, by remainder, room, place."""
    total = sum(counts)
    if not total:
        return [0] * len(counts)
    exact = [c * (n / total) for c in counts]
    seats = [int(x) for x in exact]
    part = [x - s for x, s in zip(exact, seats, strict=True)]
    order = sorted(range(len(counts)), key=lambda i: (-part[i], -counts[i], i))
    for i in order[: max(0, n - sum(seats))]:
        seats[i] += 1
    seats = [min(s, c) for s, c in zip(seats, counts, strict=True)]
    for _ in range(n - sum(seats)):
        open_ = [i for i in range(len(counts)) if seats[i] < counts[i]]
        if not open_:
            break
        seats[min(open_, key=lambda i: (-part[i], -(counts[i] - seats[i]), i))] += 1
    return seats


def seats_frame(cells: DataFrame, n: int, count: str = "n") -> DataFrame:
    """Adds ``seats`` to cells by largest remainders (cells are few; no cap is needed when ``n`` is within their sum)."""
    everything = Window.partitionBy(F.lit(0))
    exact = F.col(count) * (F.lit(float(n)) / F.sum(count).over(everything))
    keys = [c for c in cells.columns if c != count]
    place = F.row_number().over(everything.orderBy(F.desc(F.col("_exact") - F.floor("_exact")), F.desc(count), *keys))
    spare = F.lit(n) - F.sum(F.floor("_exact")).over(everything)
    return cells.withColumn("_exact", exact).withColumn("_place", place).withColumn("seats", (F.floor("_exact") + (F.col("_place") <= spare).cast("int")).cast("long")).drop("_exact", "_place")


def cell_seed(seed: int, journal: str, era: str) -> int:
    """The 64-bit seed of a cell."""
    return int.from_bytes(hashlib.blake2b(f"{seed}\0{journal}\0{era}".encode(), digest_size=8).digest(), "big")


def pool(papers: DataFrame) -> DataFrame:
    """Papers with an abstract worth labelling: pmid as number, journal, year, era, title, abstract."""
    return papers.filter(has_text(F.col("abstract"))).select(
        F.col("pmid").cast("long").alias("pmid"), F.col("journal_slug").alias("journal"), "year", era_of_sample(F.col("year")).alias("era"), "title", "abstract"
    )


def stratified(papers: DataFrame, topics: DataFrame | None, n: int = 500, seed: int = 20260522, eras: list[str] = ERAS, least_topics: int = 80) -> DataFrame:
    """Exactly ``n`` papers dealt to cells of journal and era by largest remainders, drawn from each cell by its own
    seed. ValueError for an empty pool, a cell left out, or too few topics."""
    expose_package(papers.sparkSession)
    rows = pool(papers)
    topic = topics.select("pmid", "topic_id") if topics is not None else rows.select("pmid", F.lit(None).cast("long").alias("topic_id")).limit(0)
    rows = rows.join(topic, "pmid", "left").filter(F.col("era").isin(eras) & F.col("journal").isNotNull())
    counts = {(r.journal, r.era): r.n for r in rows.groupBy("journal", "era").agg(F.count(F.lit(1)).alias("n")).collect()}  # journals times eras
    if not counts:
        raise ValueError("no papers to sample from")
    cells = [(j, e) for j in sorted({j for j, _ in counts}) for e in eras]
    seats = allocate([counts.get(c, 0) for c in cells], n)
    if sum(seats) != n:
        raise ValueError(f"{n} papers asked for, {sum(seats)} to be had")
    left_out = [c for c, s in zip(cells, seats, strict=True) if counts.get(c) and not s]
    if left_out:
        raise ValueError(f"cells without a seat: {left_out}")
    drawn = {c: (s, cell_seed(seed, *c)) for c, s in zip(cells, seats, strict=True)}
    place = F.row_number().over(Window.partitionBy("journal", "era").orderBy("pmid", "title")) - 1
    wanted = [(j, e, int(i)) for (j, e), (s, own) in drawn.items() if s for i in np.random.default_rng(own).choice(counts[j, e], size=s, replace=False)]
    picks = papers.sparkSession.createDataFrame(wanted, "journal string, era string, _place int")  # n rows
    out = rows.withColumn("_place", place).join(F.broadcast(picks), ["journal", "era", "_place"]).select("pmid", "journal", "year", "era", "topic_id", "title", "abstract")
    covered = out.agg(F.countDistinct(F.when(F.col("topic_id") != -1, F.col("topic_id")))).first()[0]
    if topics is not None and covered < least_topics:
        raise ValueError(f"{covered} topics covered, {least_topics} needed")
    return out.orderBy("pmid")


def hashed_sample(df: DataFrame, cells: list[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """The ``n`` rows of each cell of the lowest hashed keys, for samples that SQL can check."""
    order = [F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*cells).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")


def rarest_labels(pairs: DataFrame, key: str = "pmid", label: str = "mesh", most: int = 25, least: int = 5, rows: int = 20) -> tuple[int, DataFrame]:
    """(number of labels, each key's rarest one of them, ties by name) for the largest number of top labels, from
    ``most`` down, for which every label has ``rows`` keys; ValueError below ``least``."""
    return rarest_of_sets(pairs.groupBy(key).agg(F.collect_set(label).alias("_labels")), F.col("_labels"), key, label, most, least, rows)


def merged_sets(rows: DataFrame, items: Column, key: str, name: str = "_labels") -> DataFrame:
    """Rows (key, different items) with unique keys. Only rows whose key isn't unique are shuffled."""
    several = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key")
    sets = rows.select(key, F.array_distinct(items).alias(name))
    if several.isEmpty():
        return sets
    same = F.col(key).eqNullSafe(F.col("_key"))
    many = sets.join(several, same, "left_semi").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(name))).alias(name))
    return sets.join(several, same, "left_anti").union(many)


def rarest_of_sets(rows: DataFrame, labels: Column, key: str = "pmid", label: str = "mesh", most: int = 25, least: int = 5, rows_each: int = 20) -> tuple[int, DataFrame]:
    """``rarest_labels`` of rows with an array of different labels and a unique key: counts alone are shuffled, and each row's
    label is picked from its own array."""
    counts = rows.select(F.explode(labels).alias(label)).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(most).collect()
    for k in range(min(most, len(counts)), least - 1, -1):
        top = [r[label] for r in sorted(counts[:k], key=lambda r: (r.n, r[label]))]
        chosen = rows.select(key, F.explode(F.slice(F.array_intersect(F.array(*map(F.lit, top)), labels), 1, 1)).alias(label))
        sizes = {r[label]: r["count"] for r in chosen.groupBy(label).count().collect()} if rows_each > 0 else {}
        if min(sizes.get(r[label], 0) for r in counts[:k]) >= rows_each:
            return k, chosen
    raise ValueError(f"no {least} labels have {rows_each} rows each")


# Sheets


def sheet(sample: DataFrame, rater: str) -> DataFrame:
    """The sheet a rater fills in."""
    empty = [F.lit("").alias(f) for f in FIELDS]
    return sample.select("pmid", F.lit(rater).alias("rater"), "title", "abstract", *empty, F.lit("").alias("notes"))


def codebook(spark) -> DataFrame:
    """Allowed values of the fields."""
    rows = [("study_design", v) for v in STUDY_DESIGNS] + [("effect_direction", v) for v in EFFECTS]
    rows += [(f, v) for f in ("has_control", "statistical_claim_present", "coi_disclosed_in_abstract") for v in ("TRUE", "FALSE")]
    return spark.createDataFrame(rows, "field string, value string")


def _blank(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(F.trim(c))


def validated(cells: DataFrame) -> DataFrame:
    """Text cells of label fields as typed columns, with ``valid`` and the ``reason`` of the first error.

    The effect "null" is a word of the vocabulary; a missing effect, size or control is a null."""
    c = {f: _blank(F.col(f).cast("string")) for f in FIELDS}
    typed = {f: c[f] for f in ("study_design", "effect_direction")} | {f: as_boolean(c[f]) for f in ("has_control", "statistical_claim_present", "coi_disclosed_in_abstract")}
    typed["sample_size"] = as_whole_number(c["sample_size"])
    errors = [
        F.when(c["study_design"].isNull() | ~c["study_design"].isin(STUDY_DESIGNS), "study_design"),
        F.when(c["sample_size"].isNotNull() & (typed["sample_size"].isNull() | (typed["sample_size"] < 1)), "sample_size"),
        F.when(c["has_control"].isNotNull() & typed["has_control"].isNull(), "has_control"),
        F.when(typed["statistical_claim_present"].isNull(), "statistical_claim_present"),
        F.when(c["effect_direction"].isNotNull() & ~c["effect_direction"].isin(EFFECTS), "effect_direction"),
        F.when(typed["coi_disclosed_in_abstract"].isNull(), "coi_disclosed_in_abstract"),
    ]
    rest = [x for x in cells.columns if x not in FIELDS]
    return cells.select(*rest, *[typed[f].alias(f) for f in FIELDS], F.coalesce(*errors).alias("reason")).withColumn("valid", F.col("reason").isNull())


def all_blank(cells: DataFrame) -> Column:
    return F.coalesce(*[_blank(F.col(f).cast("string")) for f in FIELDS]).isNull()


def long_labels(labels: DataFrame, imported_at: str) -> DataFrame:
    """Rows (pmid, rater, field, value, imported_at), nulls kept; booleans in lower case."""
    text = labels.select("pmid", "rater", *[F.col(f).cast("string").alias(f) for f in FIELDS])
    return text.unpivot(["pmid", "rater"], FIELDS, "field", "value").withColumn("imported_at", F.lit(imported_at))


def import_sheet(cells: DataFrame, old: DataFrame, imported_at: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(label table, row errors, summary). Valid rows replace what their rater said of a paper before; rows in error
    change nothing; rows without any label are counted only."""
    at = imported_at or datetime.now(UTC).isoformat(timespec="seconds")
    checked = validated(cells.filter(~all_blank(cells)))
    good, bad = checked.filter("valid"), checked.filter("NOT valid").select("pmid", "rater", "reason")
    new = long_labels(good, at)
    summary = {"n_rows": cells.count(), "n_imported": good.select("pmid").distinct().count(), "n_errors": bad.count()}
    return upsert(old, new, ["pmid", "rater"]), bad, summary


# Extraction by a model

Model = Callable[[str], str]


def rule_model(prompt: str) -> str:
    """An offline stand-in for a language model: labels by key words, as JSON."""
    import json
    import re

    text = prompt.rsplit("Abstract:", 1)[-1].rsplit("JSON:", 1)[0].lower()
    size = re.search(r"\b(\d+) (?:patients|participants|subjects)\b", text)
    return json.dumps({
        "study_design": "RCT" if "randomi" in text else "cohort" if "cohort" in text else "review" if "review" in text else "other",
        "sample_size": int(size[1]) if size and int(size[1]) > 0 else None, "has_control": "control" in text or None, "statistical_claim_present": "p <" in text or "p=" in text,
        "effect_direction": "positive" if "improv" in text else None, "coi_disclosed_in_abstract": "conflict of interest" in text,
    })


def check_label(body: object) -> dict:
    """The label itself if it obeys the closed schema; ValueError otherwise."""
    if not isinstance(body, dict) or set(body) - set(FIELDS):
        raise ValueError("not an object of the known fields")
    if body.get("study_design") not in STUDY_DESIGNS:
        raise ValueError("study_design")
    if body.get("effect_direction") is not None and body["effect_direction"] not in EFFECTS:
        raise ValueError("effect_direction")
    size = body.get("sample_size")
    if size is not None and (isinstance(size, bool) or not isinstance(size, int) or size < 1):
        raise ValueError("sample_size")
    if not isinstance(body.get("has_control"), (bool, type(None))):
        raise ValueError("has_control")
    for f in ("statistical_claim_present", "coi_disclosed_in_abstract"):
        if not isinstance(body.get(f), bool):
            raise ValueError(f)
    return {f: body.get(f) for f in FIELDS}


STRICT = "\nReturn one JSON object and nothing else."


def _unfenced(text: str) -> str:
    text = text.strip()
    if not text.startswith("```"):
        return text
    body = text[3:]
    first, _, rest = body.partition("\n")
    if rest and (first.strip().isalnum() or not first.strip()):
        body = rest
    return body.removesuffix("```").strip()


def extract(rows: DataFrame, model: Model = rule_model, model_id: str = "rules", version: str = "v0.1", at: str | None = None) -> DataFrame:
    """Rows (pmid, ok, label fields, reason, raw_response, model_id, prompt_version, at) of (pmid, prompt): one more
    try with a strict ending where the first answer is not a valid label; all exceptions go to the failures."""
    import json

    expose_package(rows.sparkSession)
    now = at or datetime.now(UTC).isoformat(timespec="seconds")
    kinds = "study_design string, sample_size long, has_control boolean, statistical_claim_present boolean, effect_direction string, coi_disclosed_in_abstract boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pmid, prompt in zip(batch["pmid"], batch["prompt"], strict=True):
                raw, reason, label = "", "", None
                for ending in ("", STRICT):
                    try:
                        raw = model((prompt or "") + ending)
                        label = check_label(json.loads(_unfenced(raw)))
                        break
                    except Exception as e:
                        reason = f"{type(e).__name__}: {e}"[:200]
                out.append({"pmid": pmid, "ok": label is not None, **(label or dict.fromkeys(FIELDS)), "reason": None if label else reason, "raw_response": raw, "model_id": model_id, "prompt_version": version, "at": now})
            yield pd.DataFrame(out, columns=["pmid", "ok", *FIELDS, "reason", "raw_response", "model_id", "prompt_version", "at"]).astype(object)

    return rows.select(F.col("pmid").cast("long").alias("pmid"), "prompt").mapInPandas(run, f"pmid long, ok boolean, {kinds}, reason string, raw_response string, model_id string, prompt_version string, at string")


def pilot(rows: DataFrame, n: int, **how) -> tuple[DataFrame, DataFrame]:
    """(successes, failures) of the first ``n`` rows by pmid, in the declared schemas."""
    done = extract(rows.orderBy("pmid").limit(n), **how)
    good = done.filter("ok").withColumnRenamed("at", "extracted_at")
    return conform(good, "epistemic_pilot"), conform(done.filter("NOT ok").withColumnRenamed("at", "failed_at"), "epistemic_pilot_failed")
