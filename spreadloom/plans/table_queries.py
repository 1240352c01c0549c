"""Queries of filters, joins, aggregates, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadloom.functions import columns as x
from spreadloom.operators import aggregates as a
from spreadloom.operators import tables as t
from spreadloom.plans.registry import register
from spreadloom.sources import panels


def r6(df, *keys, six=(), places=6):
    return df.select(*keys, *[(F.round(c, places) + 0.0).alias(c) for c in six])


def sql6(names, places=6):
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


@register("SELECT symbol, dt, round(close, 6) AS close FROM bars WHERE dt BETWEEN '1997-01-01' AND '1997-12-31'")
def b02_date_slice(spark, d):
    return r6(t.sliced(panels.bars(spark, d), "1997-01-01", "1997-12-31"), "symbol", "dt", six=["close"])


@register("SELECT symbol, dt, round(coalesce(CASE WHEN volume > 100 THEN close END, vwap), 6) AS price FROM bars")
def b01_price_choice(spark, d):
    b = panels.bars(spark, d).withColumn("Close", F.when(F.col("volume") > 100, F.col("close"))).select("symbol", "dt", "Close", "vwap")
    return r6(t.first_present(b, ["Close", "Adj Close", "adj_close", "vwap"]), "symbol", "dt", six=["price"])


@register("SELECT symbol, count(*) AS n, round(avg(close), 6) AS mean FROM bars WHERE dt <= '1998-06-30' GROUP BY 1")
def b03_point_in_time(spark, d):
    return r6(t.sliced(panels.bars(spark, d), end="1998-06-30").groupBy("symbol").agg(F.count("*").alias("n"), F.avg("close").alias("mean")), "symbol", "n", six=["mean"])


FOLD_TABLE = "SELECT * FROM (VALUES (1, DATE '1995-01-01', DATE '1998-12-31', DATE '1999-01-15', DATE '1999-12-31'), (2, DATE '1995-01-01', DATE '1999-12-31', DATE '2000-01-15', DATE '2000-12-31')) AS f(fold, train_start, train_end, test_start, test_end)"
SEGS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register("SELECT dt, " + ", ".join(f"round(max(close) FILTER (WHERE symbol = '{s}'), 4) AS \"{s}\"" for s in SEGS) + " FROM segs GROUP BY 1")
def b08_long_to_wide(spark, d):
    return t.wide(panels.segment_bars(spark, d), "dt", "symbol", "close", SEGS).select("dt", *[F.round(s, 4).alias(s) for s in SEGS])


@register("SELECT dt, symbol, round(close, 4) AS value FROM segs WHERE symbol IN ('BUILDING', 'MACHINERY')")
def b08_wide_to_long(spark, d):
    return t.long(t.wide(panels.segment_bars(spark, d), "dt", "symbol", "close", SEGS), "dt", ["BUILDING", "MACHINERY"]).select("dt", "symbol", F.round("value", 4).alias("value"))


@register("""SELECT symbol, array_to_string(list_filter([CASE WHEN n < 300 THEN 'HISTORY' END, CASE WHEN adv < 40 THEN 'LIQUIDITY' END, CASE WHEN worst < 900 THEN 'PRICE' END], lambda r: r IS NOT NULL), ',') AS reasons, NOT (n < 300 OR adv < 40 OR worst < 900) AS eligible
FROM (SELECT symbol, count(*) AS n, avg(volume) AS adv, min(low) AS worst FROM bars GROUP BY 1)""")
def b09_universe_eligibility(spark, d):
    per = panels.bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("volume").alias("adv"), F.min("low").alias("worst"))
    rules = {"HISTORY": F.col("n") < 300, "LIQUIDITY": F.col("adv") < 40, "PRICE": F.col("worst") < 900}
    return t.with_reasons(per, rules).select("symbol", F.array_join("reasons", ",").alias("reasons"), "eligible")


@register("SELECT p_partkey, p_brand, CASE WHEN p_size < 5 THEN 'size' WHEN p_retailprice < 950 THEN 'price' WHEN p_type = 'PROMO' THEN 'type' END AS reason FROM part")
def b10_policy_reason(spark, d):
    rules = {"size": F.col("p_size") < 5, "price": F.col("p_retailprice") < 950, "type": F.col("p_type") == "PROMO"}
    return panels.table(spark, d, "part").select("p_partkey", "p_brand", t.first_reason(rules).alias("reason"))


@register("SELECT p_partkey, concat_ws(';', CASE WHEN p_size < 5 THEN 'size' END, CASE WHEN p_retailprice < 950 THEN 'price' END, CASE WHEN p_type = 'PROMO' THEN 'type' END) AS reasons FROM part")
def b11_rejection_reasons(spark, d):
    return panels.table(spark, d, "part").select("p_partkey", F.concat_ws(";", F.when(F.col("p_size") < 5, "size"), F.when(F.col("p_retailprice") < 950, "price"), F.when(F.col("p_type") == "PROMO", "type")).alias("reasons"))


@register("SELECT trial_id, pair, round(sharpe, 6) AS sharpe FROM trials WHERE pair IN ('Brand#1', 'Brand#2') AND sharpe BETWEEN 1 AND 3 AND state = 'COMPLETE'")
def b12_list_filter(spark, d):
    return r6(panels.trials(spark, d).where(F.col("pair").isin("Brand#1", "Brand#2") & F.col("sharpe").between(1, 3) & (F.col("state") == "COMPLETE")), "trial_id", "pair", six=["sharpe"])


@register("SELECT trial_id, CASE WHEN s >= 2.0 THEN 'A+' WHEN s >= 1.5 THEN 'A' WHEN s >= 1.2 THEN 'A-' WHEN s >= 0.9 THEN 'B+' WHEN s >= 0.6 THEN 'B' WHEN s >= 0.3 THEN 'B-' WHEN s >= 0 THEN 'C' ELSE 'D' END AS label FROM (SELECT trial_id, sharpe - 1 AS s FROM trials)")
def b13_score_label(spark, d):
    return panels.trials(spark, d).select("trial_id", x.score_label(F.col("sharpe") - 1).alias("label"))


@register("SELECT t.trial_id, t.pair, sector, round(price, 6) AS price FROM trials t LEFT JOIN meta m ON m.symbol = t.pair")
def c03_enrichment(spark, d):
    m = panels.meta(spark, d).withColumnRenamed("symbol", "pair")
    return r6(t.enriched(panels.trials(spark, d), m, ["pair"]), "trial_id", "pair", "sector", six=["price"])


RECON = """, i AS (SELECT leg_x AS symbol, sum(notional_x) AS q FROM positions GROUP BY 1), b AS (SELECT leg_y AS symbol, sum(-notional_y) AS q FROM positions GROUP BY 1)"""


@register(f"""{RECON} SELECT coalesce(i.symbol, b.symbol) AS symbol, round(i.q, 4) AS qty_internal, round(b.q, 4) AS qty_broker, CASE WHEN b.q IS NULL THEN 'orphan' WHEN i.q IS NULL THEN 'unexpected' WHEN sign(i.q) <> sign(b.q) THEN 'side_mismatch' WHEN abs(i.q - b.q) <= 1e-9 THEN 'match' WHEN abs(i.q - b.q) / greatest(abs(i.q), abs(b.q)) > 0.05 THEN 'quantity_critical' ELSE 'quantity_mismatch' END AS status FROM i FULL JOIN b ON i.symbol = b.symbol""")
def c04_reconcile(spark, d):
    p = panels.positions(spark, d)
    i, b = p.groupBy(F.col("leg_x").alias("symbol")).agg(F.sum("notional_x").alias("q")), p.groupBy(F.col("leg_y").alias("symbol")).agg(F.sum(-F.col("notional_y")).alias("q"))
    return r6(t.reconciled(i, b, "symbol", "q"), "symbol", "status", six=["qty_internal", "qty_broker"], places=4)


@register("SELECT symbol, dt, round(close, 6) AS close FROM bars WHERE symbol IN (SELECT leg_x FROM positions UNION SELECT leg_y FROM positions)")
def c07_held_symbols(spark, d):
    held = a.legs(panels.positions(spark, d)).select("symbol").distinct()
    return r6(panels.bars(spark, d).join(held, "symbol", "left_semi"), "symbol", "dt", six=["close"])


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '1999-01-01')")
def c08_stale_members(spark, d):
    fresh = panels.table(spark, d, "orders").where(F.col("o_orderdate") >= "1999-01-01").select(F.col("o_custkey").alias("c_custkey"))
    return panels.table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(fresh, "c_custkey", "left_anti")


@register("SELECT pair, trial_id, study_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, trial_id DESC) AS k FROM trials WHERE state = 'COMPLETE' AND score >= 950) WHERE k <= 5")
def c09_best_trials(spark, d):
    good = panels.trials(spark, d).where("state = 'COMPLETE' AND score >= 950")
    return r6(t.top_per(good, ["pair"], [F.col("score").desc(), F.col("trial_id").desc()], 5), "pair", "trial_id", "study_id", six=["score"])


RULES = "(VALUES ('click', 90.0, false, 'HIGH'), ('error', 5.0, true, 'LOW'), ('purchase', 50.0, false, 'MEDIUM'))"


@register(f"SELECT event_id, symbol, rule_id, severity, round(price, 6) AS value FROM ticks JOIN {RULES} r(rule_id, threshold, low_is_bad, severity) ON kind = rule_id WHERE CASE WHEN low_is_bad THEN price < threshold ELSE price >= threshold END")
def c11_rule_join(spark, d):
    rules = spark.sql(f"SELECT rule_id, CAST(threshold AS DOUBLE) AS threshold, low_is_bad, severity FROM {RULES} AS r(rule_id, threshold, low_is_bad, severity)")
    m = panels.ticks(spark, d).select("event_id", "symbol", F.col("kind").alias("rule_id"), F.col("price").alias("value"))
    return r6(t.rule_hits(m, rules), "event_id", "symbol", "rule_id", "severity", six=["value"])


OHLC = ["open", "high", "low", "close", "volume"]


@register(f"SELECT symbol, date_trunc('month', dt)::DATE AS period, round(first(open ORDER BY dt), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY dt), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY 1, 2")
def d01_resample(spark, d):
    return r6(a.resampled(panels.bars(spark, d), "month"), "symbol", "period", six=OHLC)


@register("SELECT s.symbol, s.period, n FROM (SELECT symbol, unnest(generate_series(min(dt), max(dt), INTERVAL 7 DAY))::DATE AS period FROM bars GROUP BY 1) s LEFT JOIN (SELECT symbol, dt, volume::BIGINT AS n FROM bars) b ON s.symbol = b.symbol AND s.period = b.dt")
def d01_calendar(spark, d):
    b = panels.bars(spark, d).select("symbol", F.col("dt").alias("period"), F.col("volume").cast("long").alias("n"))
    return a.on_calendar(b, "7 DAYS").select("symbol", "period", "n")


@register("SELECT symbol, count(*) AS n_rows, min(dt) AS first_dt, max(dt) AS last_dt FROM bars GROUP BY 1")
def d02_coverage(spark, d):
    return a.coverage(panels.bars(spark, d))


@register("SELECT pair, count(*) AS n_trials, count(*) FILTER (WHERE state = 'COMPLETE') AS n_complete, count(DISTINCT study_id) AS n_studies, max(study_id) AS last_study, round(max(score), 6) AS best, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90 FROM trials GROUP BY 1")
def d03_trial_summary(spark, d):
    return r6(a.trial_summary(panels.trials(spark, d)), "pair", "n_trials", "n_complete", "n_studies", "last_study", six=["best", "p10", "median", "p90"])


@register("SELECT count(*) AS n, count(*) FILTER (WHERE state = 'COMPLETE') AS n_active, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM trials")
def d04_store_summary(spark, d):
    return r6(panels.trials(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "COMPLETE").alias("n_active"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high")), "n", "n_active", six=["mean", "low", "high"])


@register("SELECT symbol, round(m, 4) AS mean, round(s, 4) AS sd, round((l - m) / s, 6) AS z, abs((l - m) / s) >= 2.5 AS is_extreme FROM (SELECT symbol, avg(close) AS m, stddev_samp(close) AS s, last(close ORDER BY dt) AS l FROM bars GROUP BY 1)")
def d05_distribution(spark, d):
    per = panels.bars(spark, d).groupBy("symbol").agg(F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"), F.max_by("close", "dt").alias("last"))
    z = x.ratio(F.col("last") - F.col("mean"), "sd")
    return per.select("symbol", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(z, 6).alias("z"), (F.abs(z) >= 2.5).alias("is_extreme"))


KPI = ["mean", "sd", "avg_win", "avg_loss", "expectancy"]
KPI6 = ["win_rate", "payoff", "profit_factor", "tail_ratio", "sharpe_n"]


@register(f"""SELECT pair, n, {sql6(KPI, 3)}, {sql6(KPI6)} FROM (SELECT pair, count(*) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS sd, avg((pnl > 0)::INT::DOUBLE) AS win_rate, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss, abs(avg(pnl) FILTER (WHERE pnl > 0) / avg(pnl) FILTER (WHERE pnl < 0)) AS payoff,
avg((pnl > 0)::INT::DOUBLE) * coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) + (1 - avg((pnl > 0)::INT::DOUBLE)) * coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0) AS expectancy, abs(sum(pnl) FILTER (WHERE pnl > 0) / sum(pnl) FILTER (WHERE pnl < 0)) AS profit_factor, quantile_cont(pnl, 0.95) / abs(quantile_cont(pnl, 0.05)) AS tail_ratio, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS sharpe_n FROM trades GROUP BY 1)""")
def d06_trade_kpis(spark, d):
    k = a.trade_kpis(panels.trades(spark, d), ["pair"])
    return k.select("pair", "n", *[F.round(c, 3).alias(c) for c in KPI], *[F.round(c, 6).alias(c) for c in KPI6])


@register("SELECT year(entry) AS year, month(entry) AS month, side, count(*) AS n, round(sum(pnl), 3) AS pnl FROM trades GROUP BY 1, 2, 3")
def d07_calendar_pnl(spark, d):
    return r6(a.calendar_pnl(panels.trades(spark, d)).withColumns({"year": F.col("year").cast("long"), "month": F.col("month").cast("long")}), "year", "month", "side", "n", six=["pnl"], places=3)


LEGS = ", legs AS (SELECT pair, strategy, leg_x AS symbol, notional_x AS notional FROM positions UNION ALL SELECT pair, strategy, leg_y, notional_y FROM positions)"
EXPO = "round(sum(abs(notional)), 4) AS gross, round(sum(greatest(notional, 0)), 4) AS long, round(sum(least(notional, 0)), 4) AS short, round(sum(notional), 4) AS net, count(DISTINCT pair) AS n_pairs, count(*) AS n_legs, round(sum(abs(notional)) / 1000000, 6) AS gross_pct"


@register(f"{LEGS} SELECT 'symbol' AS level, symbol AS name, {EXPO} FROM legs GROUP BY symbol UNION ALL SELECT 'strategy', strategy, {EXPO} FROM legs GROUP BY strategy")
def d08_exposure(spark, d):
    e = a.exposure(a.legs(panels.positions(spark, d)), ["symbol", "strategy"], 1_000_000)
    return e.select("level", "name", *[F.round(c, 4).alias(c) for c in ("gross", "long", "short", "net")], "n_pairs", "n_legs", F.round("gross_pct", 6).alias("gross_pct"))


@register(f"{LEGS} SELECT symbol, count(DISTINCT pair) AS n_pairs, round(sum(notional), 4) AS net, round(sum(abs(notional)) / (SELECT sum(abs(notional)) FROM legs), 6) AS share, count(DISTINCT pair) >= 6 OR sum(abs(notional)) / (SELECT sum(abs(notional)) FROM legs) >= 0.05 AS dominant FROM legs GROUP BY 1")
def d09_concentration(spark, d):
    c = a.concentration(a.legs(panels.positions(spark, d)), 6, 0.05)
    return c.select("symbol", "n_pairs", F.round("net", 4).alias("net"), F.round("share", 6).alias("share"), "dominant")


@register("SELECT date_trunc('month', dt)::DATE AS period, round(last(discount ORDER BY dt), 6) AS discount, round(last(tax ORDER BY dt), 6) AS tax FROM macro GROUP BY 1")
def d10_period_last(spark, d):
    m = panels.macro(spark, d).groupBy(F.date_trunc("month", "dt").cast("date").alias("period")).agg(F.max_by("discount", "dt").alias("discount"), F.max_by("tax", "dt").alias("tax"))
    return r6(m, "period", six=["discount", "tax"])


@register("""SELECT pair, n, round(total, 2) AS total, round(vol, 2) AS vol, round(mdd, 2) AS max_drawdown, round(sharpe, 6) AS sharpe, round(worst, 2) AS worst, round(vol / sum(vol) OVER (), 6) AS contribution FROM (SELECT pair, sum(pnl) AS total, stddev_samp(pnl) * sqrt(252) AS vol, min(cum - peak) AS mdd, avg(pnl) / stddev_samp(pnl) * sqrt(252) AS sharpe, min(pnl) AS worst, count(*) AS n
FROM (SELECT *, max(cum) OVER (PARTITION BY pair ORDER BY entry) AS peak FROM (SELECT pair, entry, pnl, sum(pnl) OVER (PARTITION BY pair ORDER BY entry) AS cum FROM (SELECT pair, entry, sum(pnl) AS pnl FROM trades GROUP BY 1, 2))) GROUP BY 1)""")
def d11_bucket_risk(spark, d):
    b = a.bucket_risk(panels.trades(spark, d), "pair", "pnl", "entry")
    return b.select("pair", "n", *[F.round(c, 2).alias(c) for c in ("total", "vol", "max_drawdown", "worst")], F.round("sharpe", 6).alias("sharpe"), F.round("contribution", 6).alias("contribution"))


@register("SELECT pair, exit_reason, count(*) AS n, round(avg(pnl), 3) AS mean, round(quantile_cont(pnl, 0.5), 3) AS median, round(stddev_samp(pnl), 3) AS sd, round(avg((pnl > 0)::INT::DOUBLE), 6) AS hit, round(avg(pnl) / stddev_samp(pnl), 6) AS sharpe FROM trades GROUP BY 1, 2 HAVING count(*) >= 30")
def d12_by_regime(spark, d):
    g = a.by_regime(panels.trades(spark, d), ["pair", "exit_reason"], "pnl", 30)
    return g.select("pair", "exit_reason", "n", *[F.round(c, 3).alias(c) for c in ("mean", "median", "sd")], F.round("hit", 6).alias("hit"), F.round("sharpe", 6).alias("sharpe"))


BINS = """, l AS (SELECT score, 'sharpe' AS param, sharpe AS value FROM trials UNION ALL SELECT score, 'drawdown', drawdown FROM trials), e AS (SELECT param, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1), bins AS (SELECT param, least(floor((value - lo) / ((hi - lo) / 8)) + 1, 8)::INT AS bin, count(*) AS n, quantile_cont(score, 0.5) AS median_score FROM l JOIN e USING (param) GROUP BY 1, 2)"""


@register(f"{BINS} SELECT param, bin, n, round(median_score, 6) AS median_score FROM bins")
def d20_sensitivity(spark, d):
    return r6(a.sensitivity(panels.trials(spark, d), ["sharpe", "drawdown"], "score", 8), "param", "bin", "n", six=["median_score"])


@register(f"{BINS} SELECT param, round(regr_slope(median_score, bin), 6) AS slope, count(*) AS n_bins FROM bins GROUP BY 1")
def d20_sensitivity_slope(spark, d):
    return r6(a.sensitivity_slope(a.sensitivity(panels.trials(spark, d), ["sharpe", "drawdown"], "score", 8)), "param", "n_bins", six=["slope"])


@register("SELECT param, round(cv, 6) AS cv, round(greatest(0, 1 - cv), 6) AS stability FROM (SELECT 'sharpe' AS param, stddev_samp(sharpe) / abs(avg(sharpe)) AS cv FROM trials UNION ALL SELECT 'drawdown', stddev_samp(drawdown) / abs(avg(drawdown)) FROM trials)")
def d21_param_stability(spark, d):
    return r6(a.param_stability(panels.trials(spark, d), ["sharpe", "drawdown"]), "param", six=["cv", "stability"])


@register("SELECT sector, count(*) AS n, round(avg(n_parts), 6) AS mean_parts, round(avg(price), 6) AS mean_price FROM meta GROUP BY 1")
def d22_profile(spark, d):
    return r6(panels.meta(spark, d).groupBy("sector").agg(F.count("*").alias("n"), F.avg("n_parts").alias("mean_parts"), F.avg("price").alias("mean_price")), "sector", "n", six=["mean_parts", "mean_price"])


@register("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN 'size' END AS reason FROM part UNION ALL SELECT CASE WHEN p_retailprice < 950 THEN 'price' END FROM part UNION ALL SELECT CASE WHEN p_type = 'PROMO' THEN 'type' END FROM part) WHERE reason IS NOT NULL GROUP BY 1")
def d23_rejection_counts(spark, d):
    rules = {"size": F.col("p_size") < 5, "price": F.col("p_retailprice") < 950, "type": F.col("p_type") == "PROMO"}
    return t.with_reasons(panels.table(spark, d, "part"), rules).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("SELECT 'sector' AS dim, sector AS name, count(*) AS n, count(*) * (count(*) - 1) // 2 AS n_pairs FROM meta GROUP BY 2 UNION ALL SELECT 'tier', CASE WHEN n_parts >= 85 THEN 'high' WHEN n_parts >= 75 THEN 'mid' ELSE 'low' END, count(*), count(*) * (count(*) - 1) // 2 FROM meta GROUP BY 2")
def d25_composition(spark, d):
    tier = F.when(F.col("n_parts") >= 85, "high").when(F.col("n_parts") >= 75, "mid").otherwise("low")
    rows = panels.meta(spark, d).select(F.inline(F.array(F.struct(F.lit("sector").alias("dim"), F.col("sector").alias("name")), F.struct(F.lit("tier").alias("dim"), tier.alias("name")))))
    return rows.groupBy("dim", "name").agg(F.count("*").alias("n")).withColumn("n_pairs", F.expr("n * (n - 1) div 2"))


@register("SELECT trial_id, pair, round(score, 6) AS score FROM trials ORDER BY coalesce(nullif(study_id, 50), 999999), score DESC NULLS LAST, trial_id LIMIT 25")
def f01_sorted_limit(spark, d):
    o = panels.trials(spark, d).orderBy(F.coalesce(F.nullif("study_id", F.lit(50)), F.lit(999999)), F.desc_nulls_last("score"), "trial_id").limit(25)
    return r6(o, "trial_id", "pair", six=["score"])


@register("SELECT study_id, trial_id, place FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY sharpe DESC, trial_id) AS place FROM trials) WHERE place <= 3")
def f02_top_per_group(spark, d):
    return t.top_per(panels.trials(spark, d), ["study_id"], [F.col("sharpe").desc(), F.col("trial_id")], 3).select("study_id", "trial_id", "place")


@register("SELECT symbol, dt, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM bars) WHERE k = 1")
def f03_latest(spark, d):
    return r6(t.latest(panels.bars(spark, d), ["symbol"], [F.col("dt").desc()]), "symbol", "dt", six=["close"])


@register("SELECT pair_key, pair, round(notional_x, 4) AS notional_x FROM (SELECT *, least(leg_x, leg_y) || '/' || greatest(leg_x, leg_y) AS pair_key, row_number() OVER (PARTITION BY least(leg_x, leg_y), greatest(leg_x, leg_y) ORDER BY notional_x DESC, pair) AS k FROM positions) WHERE k = 1")
def f04_dedup_pairs(spark, d):
    return r6(t.deduped_pairs(panels.positions(spark, d), "leg_x", "leg_y", [F.col("notional_x").desc(), F.col("pair")]), "pair_key", "pair", six=["notional_x"], places=4)


@register("SELECT trial_id, round(sharpe, 6) AS sharpe FROM trials k WHERE state = 'COMPLETE' AND NOT EXISTS (SELECT 1 FROM trials o WHERE state = 'COMPLETE' AND o.score >= k.score AND o.sharpe >= k.sharpe AND o.drawdown <= k.drawdown AND (o.score > k.score OR o.sharpe > k.sharpe OR o.drawdown < k.drawdown))")
def f05_pareto_front(spark, d):
    """The front of all finished trials."""
    done = panels.trials(spark, d).where("state = 'COMPLETE'")
    return r6(t.pareto_front(done, ["score", "sharpe"], ["drawdown"], "trial_id"), "trial_id", six=["sharpe"])


@register("SELECT trial_id, round(sharpe, 6) AS sharpe FROM trials k WHERE NOT EXISTS (SELECT 1 FROM trials o WHERE o.score >= k.score AND o.sharpe >= k.sharpe AND o.drawdown <= k.drawdown AND (o.score > k.score OR o.sharpe > k.sharpe OR o.drawdown < k.drawdown))")
def f05_pareto_front_all(spark, d):
    return r6(t.pareto_front(panels.trials(spark, d), ["score", "sharpe"], ["drawdown"], "trial_id"), "trial_id", six=["sharpe"])


@register("SELECT array_to_string(list(symbol ORDER BY n, symbol)[1:10], ',') AS worst FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)")
def f06_worst_list(spark, d):
    per = panels.bars(spark, d).groupBy("symbol").count()
    return per.orderBy("count", "symbol").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("count", "symbol"))), lambda s: s["symbol"]), ",").alias("worst"))


@register("SELECT symbol, dt, volume::DOUBLE AS volume, NULL::DOUBLE AS high FROM segs UNION ALL SELECT symbol, dt, volume, round(high, 6) FROM bars")
def g01_union_by_name(spark, d):
    one = panels.segment_bars(spark, d).select("symbol", "dt", F.col("volume").cast("double").alias("volume"))
    return one.unionByName(panels.bars(spark, d).select("symbol", "dt", "volume", F.round("high", 6).alias("high")), allowMissingColumns=True)


@register("SELECT dt FROM bars GROUP BY dt HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)")
def g02_common_dates(spark, d):
    return t.common_dates(panels.bars(spark, d))


DIFF = ", n AS (SELECT symbol, avg(close) AS v FROM bars WHERE dt >= '1999-01-01' AND symbol <> 'Brand#3' GROUP BY 1), o AS (SELECT symbol, avg(close) AS v FROM bars WHERE dt < '1999-01-01' AND symbol <> 'Brand#4' GROUP BY 1)"


@register(f"{DIFF} SELECT coalesce(n.symbol, o.symbol) AS symbol, CASE WHEN o.symbol IS NULL THEN 'added' WHEN n.symbol IS NULL THEN 'removed' ELSE 'both' END AS state, round(n.v - o.v, 4) AS v_delta FROM n FULL JOIN o ON n.symbol = o.symbol")
def g03_snapshot_diff(spark, d):
    b = panels.bars(spark, d)
    n = b.where("dt >= '1999-01-01' AND symbol <> 'Brand#3'").groupBy("symbol").agg(F.avg("close").alias("v"))
    o = b.where("dt < '1999-01-01' AND symbol <> 'Brand#4'").groupBy("symbol").agg(F.avg("close").alias("v"))
    return r6(t.diffed(n, o, "symbol", ["v"]), "symbol", "state", six=["v_delta"], places=4)


@register("SELECT leg_x AS symbol FROM positions UNION SELECT leg_y FROM positions")
def g04_distinct_symbols(spark, d):
    return a.legs(panels.positions(spark, d)).select("symbol").distinct()


@register("SELECT p_partkey, CASE WHEN upper(trim(p_brand)) IN ('', 'NAN', 'NONE', 'NULL') THEN NULL ELSE upper(trim(p_brand)) END AS symbol, least(p_brand, p_type) || '/' || greatest(p_brand, p_type) AS pair_key FROM part")
def h01_symbol_keys(spark, d):
    return panels.table(spark, d, "part").select("p_partkey", x.canonical_symbol("p_brand").alias("symbol"), x.pair_key("p_brand", "p_type").alias("pair_key"))


@register("SELECT event_id, try_cast(props->>'k' AS DOUBLE) AS k, try_cast(kind AS DOUBLE) AS bad FROM ticks")
def h02_coercion(spark, d):
    return panels.ticks(spark, d).select("event_id", x.to_double(F.get_json_object("props", "$.k").try_cast("double")).alias("k"), x.to_double("kind").alias("bad"))


@register("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: lower(trim(w))))), ',') AS tags FROM part")
def h03_tags(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    return panels.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.transform(words, lambda w: F.lower(F.trim(w))))), ",").alias("tags"))


@register("SELECT symbol, round(quantile_cont(gap, 0.5), 6) AS median_gap, round(365.25 / quantile_cont(gap, 0.5), 6) AS per_year FROM (SELECT symbol, date_diff('day', lag(dt) OVER (PARTITION BY symbol ORDER BY dt), dt) AS gap FROM bars) GROUP BY 1")
def h04_periods_per_year(spark, d):
    g = panels.bars(spark, d).select("symbol", F.datediff("dt", F.lag("dt").over(x.ordered())).alias("gap")).groupBy("symbol").agg(F.percentile("gap", 0.5).alias("median_gap"))
    return r6(g.withColumn("per_year", 365.25 / F.col("median_gap")), "symbol", six=["median_gap", "per_year"])


@register("SELECT trial_id, round(ln(1 + score), 6) AS log1p, round(1 / (1 + exp(-sharpe)), 6) AS logistic, round(least(greatest(sharpe * 30, 0), 100), 6) AS clipped FROM trials")
def h05_transforms(spark, d):
    return panels.trials(spark, d).select("trial_id", F.round(F.log1p("score"), 6).alias("log1p"), F.round(x.logistic("sharpe"), 6).alias("logistic"), F.round(x.clip(F.col("sharpe") * 30, 0, 100), 6).alias("clipped"))


@register("""SELECT trial_id, round(CASE WHEN sharpe BETWEEN 1 AND 3 THEN 100 ELSE 100 * exp(-greatest(1 - sharpe, sharpe - 3) / 2) END, 6) AS inside, round(CASE WHEN sharpe >= 1.5 THEN 100 ELSE 100 * exp(-(1.5 - sharpe) / 1.5) END, 6) AS above, round(CASE WHEN drawdown <= 0.2 THEN 100 ELSE 100 * exp(-(drawdown - 0.2) / 0.2) END, 6) AS below FROM trials""")
def h06_banded_scores(spark, d):
    one, three = F.lit(1.0), F.lit(3.0)
    return panels.trials(spark, d).select("trial_id", F.round(x.inside_score("sharpe", one, three), 6).alias("inside"), F.round(x.above_score("sharpe", F.lit(1.5)), 6).alias("above"), F.round(x.below_score("drawdown", F.lit(0.2)), 6).alias("below"))


@register("SELECT trial_id, round(greatest(0, 0.5 * (0.55 / (drawdown + 0.1) - 0.45 / (sharpe + 0.1))), 6) AS kelly, round(CASE WHEN drawdown <= 0.001 THEN 3 ELSE least(3, 0.15 / drawdown) END, 6) AS leverage, round(greatest(0, least(1, 1 - (drawdown - 0.05) / 0.15)), 6) AS deleverage FROM trials")
def h07_sizing(spark, d):
    tr = panels.trials(spark, d)
    return tr.select("trial_id", F.round(x.kelly(F.lit(0.55), F.col("sharpe") + 0.1, F.col("drawdown") + 0.1, 0.5), 6).alias("kelly"), F.round(x.vol_target_leverage("drawdown", 0.15, 3.0), 6).alias("leverage"), F.round(x.ramp_down("drawdown", 0.05, 0.2), 6).alias("deleverage"))


@register("SELECT o_orderkey, round(CASE WHEN o_totalprice < 20000 THEN 0 ELSE 1 + 0.005 * s + o_totalprice * 3 / 1e4 + 0.1 * o_totalprice * sqrt(s / 100000) END, 4) AS cost FROM (SELECT o_orderkey, o_totalprice, o_totalprice / 100 AS s FROM orders)")
def h08_trade_cost(spark, d):
    o = panels.table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 100).alias("s"))
    return o.select("o_orderkey", F.round(x.trade_cost("o_totalprice", "s", F.lit(100000.0), least=20000.0), 4).alias("cost"))


@register("SELECT p_partkey, substr(sha256(p_brand || '|' || p_type), 1, 16) AS id FROM part")
def h10_stable_id(spark, d):
    return panels.table(spark, d, "part").select("p_partkey", F.substring(F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256), 1, 16).alias("id"))


@register("SELECT event_id, (props->>'k')::BIGINT AS k, kind FROM ticks WHERE (props->>'k')::BIGINT >= 50")
def a13_json_decode(spark, d):
    e = panels.ticks(spark, d).withColumn("p", F.from_json("props", "k long"))
    return e.where("p.k >= 50").select("event_id", F.col("p.k").alias("k"), "kind")


@register("SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS dt, l_quantity FROM lineitem WHERE l_shipdate BETWEEN '1996-01-01' AND '1996-03-31' AND l_partkey < 500")
def a03_pushed_scan(spark, d):
    scan = panels.table(spark, d, "lineitem").where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_shipdate") <= F.lit("1996-03-31").cast("timestamp")) & (F.col("l_partkey") < 500))
    return scan.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("dt"), "l_quantity")


@register("SELECT symbol, dt, round(close, 6) AS close, CASE WHEN dt >= '2000-01-01' THEN 'new' ELSE 'old' END AS src FROM bars")
def a10_upsert(spark, d):
    b = panels.bars(spark, d).select("symbol", "dt", F.round("close", 6).alias("close"))
    return t.upserted(b.withColumn("src", F.lit("old")), t.sliced(b, "2000-01-01").withColumn("src", F.lit("new")), ["symbol", "dt"])


@register("""SELECT symbol, lo::DATE AS lo, least(hi, lo + INTERVAL 364 DAY)::DATE AS hi FROM (SELECT symbol, hi, unnest(generate_series(lo, hi, INTERVAL 365 DAY)) AS lo FROM (
SELECT symbol, DATE '1994-01-01' AS lo, (min(dt) - INTERVAL 1 DAY)::DATE AS hi FROM bars GROUP BY 1 UNION ALL SELECT symbol, (max(dt) + INTERVAL 1 DAY)::DATE, DATE '2003-12-31' FROM bars GROUP BY 1) WHERE lo <= hi)""")
def a14_ingest_gaps(spark, d):
    have = a.coverage(panels.bars(spark, d)).select("symbol", "first_dt", "last_dt")
    wanted = have.select("symbol", F.lit("1994-01-01").cast("date").alias("start"), F.lit("2003-12-31").cast("date").alias("end"))
    return t.ingest_gaps(wanted, have)
