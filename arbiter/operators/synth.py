"""Generators: scenarios, distractors and confounded corpora by hashing, so that every run makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events of each scenario in order, with days after the one before, and the expected answer.
SCENARIOS = {
    "T0": (["pre_clearance_approved"], "active"),
    "T1": (["pre_clearance_approved", "blackout_announced"], "non_compliant"),
    "T2": (["pre_clearance_approved", "blackout_announced", "emergency_exception"], "compliant"),
    "T3": (["pre_clearance_approved", "blackout_announced", "blackout_lifted"], "non_compliant"),
}
SECURITY_SCENARIOS = {"T0": (["cve_disclosed"], "vulnerable"), "T1": (["cve_disclosed", "patch_released"], "patched")}
LEGAL_SCENARIOS = {"T0": (["ruling_issued"], "good_law"), "T1": (["ruling_issued", "ruling_overruled"], "overruled")}


def pick(values: list[str] | int, *key: Column, seed: int = 42) -> Column:
    """One of the values, or a number below ``values``, by the key's hash."""
    n = values if isinstance(values, int) else len(values)
    at = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n)).cast("int")
    return at if isinstance(values, int) else F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)


def entity_pairs(spark: SparkSession, employees: int, tickers: int, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct (employee, ticker) pairs in hash order; an error if there are fewer."""
    if n > employees * tickers:
        raise ValueError(f"{n} pairs of {employees} employees and {tickers} tickers")
    every = spark.range(employees * tickers).select(F.format_string("EMP%03d", (F.col("id") / tickers).cast("int")).alias("employee"), F.format_string("TK%02d", (F.col("id") % tickers).cast("int")).alias("ticker"), "id")
    return every.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("employee", "ticker")


def pairs_of(employees: DataFrame, tickers: DataFrame, per: int) -> DataFrame:
    """``employee, ticker, number``: ``per`` different tickers for each employee, of ``employees(id)`` and ``tickers(id)``, ids from 0 without gaps.

    Tickers are met by an equi-join on their ids; how many there are is a one-row table. With fewer tickers than ``per`` each has all.
    """
    n = F.broadcast(tickers.agg(F.count("*").alias("n")))
    e = employees.crossJoin(n).select(F.col("id").alias("employee"), "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(per), F.col("n").cast("int")) - 1)).alias("j"))
    wanted = e.where("n > 0").select("employee", ((F.col("employee") * 7 + F.col("j")) % F.col("n")).alias("id"), (F.col("employee") * per + F.col("j")).alias("number"))
    return wanted.join(tickers.select("id"), "id").select("employee", F.col("id").alias("ticker"), "number")


def scenario_events(pairs: DataFrame, scenarios: dict | None = None, start: str = "2024-01-01 09:00:00", seed: int = 42) -> DataFrame:
    """Events of every pair's scenario: ``example_id, hop_type, event_id, event_type, ts, employee_id, security_ticker, answer``.

    Scenario, first day and gap are mixed from a pair's ``number`` if it has one, else picked by hash.
    """
    scenarios = scenarios or SCENARIOS
    key = F.concat_ws("-", "employee", "ticker")
    numbered = "number" in pairs.columns
    some = lambda values, salt, *of: mixed(values, F.col("number"), salt) if numbered else pick(values, *of, seed=seed)
    rows = pairs.withColumn("example_id", key)
    rows = rows.withColumn("hop_type", some(list(scenarios), 13, F.col("example_id"))).withColumn("day", some(28, 11, F.col("example_id"))).withColumn("gap", 1 + some(3, 12, F.col("example_id"), F.lit("gap")))
    rows = rows.select("employee", "ticker", "example_id", "hop_type", "day", "gap")
    kinds, answer = F.lit(None), F.lit(None)
    for name, (events, a) in scenarios.items():
        kinds = F.when(F.col("hop_type") == name, F.array(*(F.lit(e) for e in events))).otherwise(kinds)
        answer = F.when(F.col("hop_type") == name, F.lit(a)).otherwise(answer)
    rows = rows.select("*", answer.alias("answer"), F.posexplode(kinds).alias("pos", "event_type"))
    first = F.to_timestamp(F.lit(start)) + F.make_dt_interval(F.col("day"))
    after = F.make_dt_interval(F.col("pos") * F.col("gap"))
    return rows.select("example_id", "hop_type", F.concat_ws("-e", "example_id", F.col("pos").cast("string")).alias("event_id"), "event_type", (first + after).alias("ts"), F.col("employee").alias("employee_id"), F.col("ticker").alias("security_ticker"), "answer")


def distractors(examples: DataFrame, per_example: int, types: list[str], templates: list[str], contaminated: bool = False, seed: int = 42) -> DataFrame:
    """Events that answer nothing, in three modes by number: another ticker, another employee, both others.

    ``examples(employee, ticker, ts)``. Without ``contaminated`` no gold pair gets any; times lie within five days.
    """
    gold = examples.select("employee", "ticker").distinct()
    key = [F.col("employee"), F.col("ticker"), F.col("d")]
    d = examples.select("employee", "ticker", "ts").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(per_example - 1))))
    mode = F.col("d") % 3
    other = lambda c, tag: F.concat(F.col(c), F.lit("X"), pick(9, *key, F.lit(tag), seed=seed).cast("string"))
    d = d.select(
        "employee", "ticker", "d",
        F.when((mode == 0) | F.lit(contaminated), F.col("employee")).otherwise(other("employee", "e")).alias("e2"),
        F.when((mode == 1) | F.lit(contaminated), F.col("ticker")).otherwise(other("ticker", "t")).alias("t2"),
        pick(types, *key, seed=seed).alias("event_type"), pick(templates, *key, seed=seed).alias("template"),
        (F.col("ts") + F.make_dt_interval(pick(11, *key, F.lit("ts"), seed=seed) - 5)).alias("ts"),
    )
    text = F.replace(F.replace("template", F.lit("{emp}"), F.col("e2")), F.lit("{ticker}"), F.col("t2"))
    out = d.select(F.concat_ws("_", F.lit("distractor"), "employee", "ticker", F.col("d").cast("string")).alias("event_id"), "event_type", "ts", F.col("e2").alias("employee"), F.col("t2").alias("ticker"), text.alias("text"))
    return out if contaminated else out.join(gold, ["employee", "ticker"], "left_anti")


def kappa_corpus(gold: DataFrame, kappa: int) -> DataFrame:
    """Every gold row and ``kappa - 1`` copies of the same scope, numbered by ``copy``; the gold one is 0."""
    return gold.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(kappa - 1))))


def scope_pick(bucket: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One of each scope's rows by a given order, as a hash for 'any'."""
    from pyspark.sql import Window as W

    return bucket.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def mixed(values: list[str] | int, at: Column, salt: int) -> Column:
    """One of the values, or a number below ``values``, by a row number: a mixture that plain SQL can repeat."""
    n = values if isinstance(values, int) else len(values)
    k = (((at + 1) * (7919 + 2 * salt)) % 100003 % n).cast("int")
    return k if isinstance(values, int) else F.element_at(F.array(*(F.lit(v) for v in values)), k + 1)


PRODUCTS = ["amber-proxy", "basalt", "cobalt-db", "dune-web", "ember", "fjord-mail", "garnet", "harbor-ui"]
FLAWS = ["lets a remote user run commands", "leaks memory of other requests", "follows paths out of its folder", "trusts forged tokens"]
REASONS = ["glass particles", "a wrong label", "failed dissolution", "mould"]
CASES = ["Ash v. Birch", "Cedar v. Dale", "Elm v. Frost", "Grove v. Heath", "Ives v. Jay"]


def security_corpus(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """``doc_id, kind, product, cve_id, text``: disclosures of ``pairs(id, product, cve_id, disclosure_text, patch_text)``, their patches, and a distractor for each of ``others(id)``.

    Ids are three times the given ones, and one and two more: no row needs to know of another.
    """
    i = F.col("id")
    real = [pairs.select((3 * i + off).alias("doc_id"), F.lit(kind).alias("kind"), "product", "cve_id", F.col(text).alias("text")) for kind, text, off in (("disclosure", "disclosure_text", 0), ("patch", "patch_text", 1))]
    product, cve = mixed(PRODUCTS, i, 1), F.concat(F.lit("CVE-2023-"), F.lpad((i + 90000).cast("string"), 7, "0"))
    text = F.concat(cve, F.lit(" was found in "), product, F.lit(": it "), mixed(FLAWS, i, 2), F.lit(". Versions up to "), mixed(9, i, 3).cast("string"), F.lit("."), mixed(10, i, 4).cast("string"), F.lit(" have it, and there is no patch."))
    noise = others.select((3 * i + 2).alias("doc_id"), F.lit("distractor").alias("kind"), product.alias("product"), cve.alias("cve_id"), text.alias("text"))
    return real[0].unionAll(real[1]).unionAll(noise)


def recall_corpus(products: DataFrame) -> DataFrame:
    """``doc_id, drug, text`` of ``products(id, name)``: notices of those with even ids, which are recalled, and labels of the others."""
    i, drug = F.col("id"), F.col("name")
    recalled = F.concat(F.lit("Lot "), i.cast("string"), F.lit(" of "), drug, F.lit(" is recalled for "), mixed(REASONS, i, 6), F.lit("."))
    label = F.concat(drug, F.lit(" is taken "), (mixed(3, i, 7) + 1).cast("string"), F.lit(" times a day."))
    return products.select(i.alias("doc_id"), drug.alias("drug"), F.when(i % 2 == 0, recalled).otherwise(label).alias("text"))


def ruling_corpus(cases: DataFrame) -> DataFrame:
    """``doc_id, case_slug, text`` of ``cases(id, name)``: rulings that cite other cases and overrule none."""
    from arbiter.functions import text as T

    i = F.col("id")
    cite = F.concat("name", F.lit(", "), (mixed(500, i, 9) + 1).cast("string"), F.lit(" U.S. "), (i + 1).cast("string"))
    return cases.select(i.alias("doc_id"), T.slug(cite).alias("case_slug"), F.concat(cite, F.lit(" is followed here, as in "), mixed(CASES, i, 10), F.lit(".")).alias("text"))


def confounders(examples: DataFrame, scope: list[str], per_example: int, keep: list[list[str]]) -> DataFrame:
    """Distractors ``id, d, scope`` of ``examples(id, scope)``: number ``d`` has the example's values of ``keep[d % len(keep)]`` and others elsewhere.

    Of security examples, one mode keeps the identifier and not the product; of legal ones, one keeps the case.
    """
    d = examples.select("id", *scope).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(per_example - 1))))
    mode = F.col("d") % len(keep)
    other = lambda c: F.concat(F.col(c).cast("string"), F.lit("-x"), F.col("d").cast("string"))
    kept = lambda c: F.array_contains(F.array(*(F.lit(m) for m, names in enumerate(keep) if c in names)), mode) if any(c in names for names in keep) else F.lit(False)
    return d.select("id", "d", *(F.when(kept(c), F.col(c).cast("string")).otherwise(other(c)).alias(c) for c in scope))
