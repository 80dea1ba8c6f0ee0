"""Look-back statistics in a number of steps that does not grow with the look-back.

A range frame adds up every row of its range again for each row: 365 additions a row for the yearly look-back. Here each
row is an event that enters at its day and one that leaves when the look-back has passed it; running sums over the events are
the sums over the range. Extremes use blocks as long as the range: a range lies in two neighbouring blocks, as a tail of the
first, whose extreme is a running one from the block's end, and a head of the second, a running one from its start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyframe.functions import units

#: A variance below this share of the mean square is rounding, not variation.
ROUNDING = 1e-11


#: Values that are not finite are counted in one number, a million and more of each kind.
NAN, UP, DOWN = 1, 1 << 21, 1 << 42


def totals(frame: DataFrame, variables: list[str], days: int, keys: list[str]) -> DataFrame:
    """``frame`` with ``_n_<variable>`` and ``_s_<variable>``: how many values the last ``days`` days up to and including the
    row's own hold, and their sum (null if none).

    Both are a running total less the running total of what lies before the range, so a row costs two additions whatever
    the look-back, in one sort by ``keys`` and ``_day``. Values that are not finite are counted, not added up, so that they
    do not reach beyond their range. Rounding grows with what a group of ``keys`` holds, not with the range."""
    order = Window.partitionBy(*keys).orderBy("_day")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rangeBetween(Window.unboundedPreceding, -days - 1)
    columns, running = frame.columns, {}
    for v in variables:
        x = F.col(v).cast("double")
        kind = F.when(F.isnan(x), NAN).when(x == float("inf"), UP).when(x == float("-inf"), DOWN)
        counted = {"n": F.when(x.isNotNull(), 1), "s": F.when(kind.isNull(), x), "odd": kind.cast("long")}
        running |= {f"_{side}_{name}_{v}": F.sum(value).over(window)
                    for name, value in counted.items() for side, window in (("now", so_far), ("before", before))}
    summed = frame.withColumns(running)

    def inside(name: str) -> Column:
        # rows without a day are a range of their own
        left = F.when(F.col("_day").isNotNull(), F.col(f"_before_{name}"))
        return F.coalesce(F.col(f"_now_{name}"), F.lit(0)) - F.coalesce(left, F.lit(0))

    out = []
    for v in variables:
        n, odd = inside(f"n_{v}"), inside(f"odd_{v}")
        nan, up, down = odd.bitwiseAND(UP - 1) > 0, F.shiftright(odd, 21).bitwiseAND(UP - 1) > 0, odd >= DOWN
        total = (F.when(odd == 0, inside(f"s_{v}")).when(nan | (up & down), float("nan"))
                 .when(up, float("inf")).otherwise(float("-inf")))
        out += [n.alias(f"_n_{v}"), F.when(n > 0, total).alias(f"_s_{v}")]
    return summed.select(*columns, *out)


def means(daily: DataFrame, days: int, variables: list[str]) -> DataFrame:
    """``daily`` with the mean of each variable over the last ``days`` days, named as ``rolling`` does."""
    summed = totals(daily.withColumn("_day", units.epoch_day(F.col("obs_date"))), variables, days, ["station_id"])
    return summed.select(*daily.columns, *[(F.col(f"_s_{v}") / F.col(f"_n_{v}")).alias(f"{v}_rolling_{days}d_mean") for v in variables])


def _centred(daily: DataFrame, variables: list[str]) -> DataFrame:
    """Adds each value less its station's mean, so that squares keep their digits."""
    station = Window.partitionBy("station_id")
    return daily.withColumns({f"_mean_{v}": F.coalesce(F.avg(v).over(station), F.lit(0.0)) for v in variables})


def moments(daily: DataFrame, specs: dict[int, dict[str, list[str]]]) -> DataFrame:
    """Means, deviations and sums over the last ``days`` days up to and including the row's own.

    One sort of the events, which are as many as rows times look-backs plus one; all rows of a day see all that enters on
    that day, as in a range frame."""
    variables = sorted({v for spec in specs.values() for v in spec})
    columns = daily.columns
    frame = _centred(daily.withColumn("_day", units.epoch_day(F.col("obs_date"))), variables)
    values = F.struct(*[(F.col(v) - F.col(f"_mean_{v}")).alias(v) for v in variables])
    # the station stays a column of its own, so that what follows knows how the rows are dealt
    others = [c for c in columns if c != "station_id"]
    row = F.struct(*others, *[f"_mean_{v}" for v in variables])
    enter = F.struct(F.col("_day").alias("at"), F.lit(0).alias("leaves"), values.alias("x"), row.alias("row"))
    leave = [F.struct((F.col("_day") + days + 1).alias("at"), F.lit(days).alias("leaves"), values.alias("x"), F.lit(None).alias("row"))
             for days in sorted(specs)]
    events = frame.select("station_id", F.explode(F.array(enter, *leave)).alias("e")).select("station_id", "e.*")
    so_far = Window.partitionBy("station_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def total(value: Column, days: int) -> Column:
        signed = F.when(F.col("leaves") == 0, value).when(F.col("leaves") == days, -value)
        return F.sum(signed).over(so_far)

    sums: dict[str, Column] = {}
    for days, spec in specs.items():
        for v, stats in spec.items():
            if set(stats) & {"mean", "std", "sum"}:
                x = F.col(f"x.{v}")
                sums[f"_n_{days}_{v}"] = total(F.when(x.isNotNull(), 1), days)
                sums[f"_s_{days}_{v}"] = total(x, days)
                sums[f"_q_{days}_{v}"] = total(x * x, days)
    summed = events.withColumns(sums).where("row IS NOT NULL").select("station_id", "row.*", *sums)

    out: dict[str, Column] = {}
    for days, spec in specs.items():
        for v, stats in spec.items():
            n, s, q, mean = F.col(f"_n_{days}_{v}"), F.col(f"_s_{days}_{v}"), F.col(f"_q_{days}_{v}"), F.col(f"_mean_{v}")
            left = q - s * s / n
            variance = F.when(left <= ROUNDING * (q + n * mean * mean), 0.0).otherwise(left / (n - 1))
            known = {"mean": s / n + mean, "sum": s + n * mean, "std": F.when(n > 1, F.sqrt(variance))}
            out |= {f"{v}_rolling_{days}d_{stat}": F.when(n > 0, known[stat]) for stat in stats if stat in known}
    return summed.select(*columns, *[c.alias(name) for name, c in out.items()])


def extremes(daily: DataFrame, days: int, spec: dict[str, list[str]]) -> DataFrame:
    """Minima and maxima over the last ``days`` days up to and including the row's own."""
    names = {f"{v}_rolling_{days}d_{stat}": (v, stat) for v, stats in spec.items() for stat in stats if stat in ("min", "max")}
    if not names:
        return daily
    width, columns = days + 1, daily.columns
    pick = {"min": F.min, "max": F.max}
    both = {"min": F.least, "max": F.greatest}
    frame = daily.withColumn("_day", units.epoch_day(F.col("obs_date"))).withColumn("_block", F.floor(F.col("_day") / width))
    head = Window.partitionBy("station_id", "_block").orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    frame = frame.withColumns({f"_head_{c}": pick[stat](v).over(head) for c, (v, stat) in names.items()})
    values = F.struct(*[F.col(v) for v in sorted({v for v, _ in names.values()})])
    row = F.struct(*[c for c in columns if c != "station_id"], *[f"_head_{c}" for c in names])
    own = F.struct(F.col("_block").alias("block"), F.col("_day").alias("at"), values.alias("x"), F.lit(None).alias("row"))
    # the row asks the block before its own for everything from the first day of its range on
    asks = F.struct((F.col("_block") - 1).alias("block"), (F.col("_day") - days).alias("at"), F.lit(None).alias("x"), row.alias("row"))
    events = frame.select("station_id", F.explode(F.array(own, asks)).alias("e")).select("station_id", "e.*")
    tail = Window.partitionBy("station_id", "block").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = events.withColumns({f"_tail_{c}": pick[stat](f"x.{v}").over(tail) for c, (v, stat) in names.items()})
    found = found.where("row IS NOT NULL").select("station_id", "row.*", *[f"_tail_{c}" for c in names])
    return found.select(*columns, *[both[stat](f"_head_{c}", f"_tail_{c}").alias(c) for c, (_, stat) in names.items()])


def rolling(daily: DataFrame, specs: dict[int, dict[str, list[str]]]) -> DataFrame:
    """``daily`` with the columns of ``specs``, equal to the range-frame form of ``operators.rolling`` up to rounding.

    A look-back without a value gives null, one with a single value no deviation. Repeated days are all counted. Everything is
    partitioned by station; one shuffle."""
    frame = moments(daily, specs)
    for days, spec in specs.items():
        frame = extremes(frame, days, spec)
    order = [f"{v}_rolling_{days}d_{stat}" for days, spec in sorted(specs.items()) for v, stats in spec.items() for stat in stats]
    return frame.select(*daily.columns, *order)
