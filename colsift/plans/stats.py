"""Statistics of one table, each computed once and shared by the operators.

`need` runs one aggregate over the table for the groups of metrics asked for and keeps the few numbers that come back;
`frame` hands them to an operator as a one-row-per-column local relation. Wide tables are aggregated in chunks of columns,
so every column is still read once and the generated code stays small.
"""

from __future__ import annotations

import math
from functools import cached_property, partial

from pyspark.sql import DataFrame, functions as F, types as T

from colsift.functions.values import as_double, is_missing, is_padded, ref, to_number, to_time
from colsift.plans import frequencies, quantiles
from colsift.plans.fingerprints import duplicate_count
from colsift.plans.pairs import Moments, pair_correlations
from colsift.plans.roles import DATETIME_TYPES, column_roles
from colsift.plans.session import small_frame, together

# with many more the generated methods are too long to be compiled to machine code
EXPRESSIONS_PER_SCAN = 32

# how many of the most frequent values the reports show per text column
TOP_VALUES = 5

# Result type of every metric.
METRIC_TYPES = {
    "n_null": "bigint", "n": "bigint", "mean": "double", "min": "double", "max": "double", "std_samp": "double",
    "std_pop": "double", "var_samp": "double", "skew": "double", "kurtosis": "double", "n_whole": "bigint",
    "n_not_number": "bigint", "n_number": "bigint", "n_padded": "bigint", "n_bad_date": "bigint",
    "earliest": "timestamp_ntz", "latest": "timestamp_ntz", "n_unique": "bigint", "top_count": "bigint",
    "low_count": "bigint",
}


class TableStats:
    def __init__(self, df: DataFrame, flavor: str = "E", small_count: int = quantiles.SMALL_COUNT):
        self.df = df
        self.flavor = flavor
        self.roles = column_roles(df, flavor)
        self.small_count = small_count
        self._groups: set[str] = set()
        self._facts: dict[str, dict] = {c: {} for c in df.columns}
        self._quantiles: dict[tuple, float] = {}
        self._top: dict[str, list] = {}
        self._top_k: dict[str, int] = {}

    @property
    def spark(self):
        return self.df.sparkSession

    @property
    def n_rows(self) -> int:
        self.need("nulls")
        return self._n_rows

    @property
    def missing_cells(self) -> int:
        self.need("nulls")
        return sum(f["n_null"] for f in self._facts.values())

    def numeric(self, name: str):
        return as_double(ref(name), self.roles.types[name])

    def fact(self, column: str, metric: str):
        return self._facts[column].get(metric)

    def _metrics(self, group: str) -> list[tuple]:
        """(column, metric, expression) of one group."""
        types = self.roles.types
        if group == "nulls":
            return [(c, "n_null", F.count_if(is_missing(ref(c), types[c]))) for c in self.df.columns]
        if group == "moments":
            kinds = {"mean": F.avg, "min": F.min, "max": F.max, "var_pop": F.var_pop}
            return [(c, m, f(self.numeric(c))) for c in self.roles.numeric for m, f in kinds.items()]
        if group == "shape":
            kinds = {"skew": F.skewness, "kurtosis": F.kurtosis}
            return [(c, m, f(self.numeric(c))) for c in self.roles.numeric for m, f in kinds.items()]
        if group == "whole":
            return [(c, "n_whole", F.count_if(F.abs(self.numeric(c) - F.rint(self.numeric(c))) < 1e-10))
                    for c in self.roles.numeric]
        if group == "text":
            found = []
            for c in self.roles.categorical:
                number = to_number(ref(c))
                found += [(c, "n_not_number", F.count_if(ref(c).isNotNull() & number.isNull())),
                          (c, "n_number", F.count(number)),
                          (c, "n_padded", F.count_if(is_padded(ref(c))))]
            return found
        if group == "dates":
            found = []
            for c in self.df.columns:
                if isinstance(types[c], DATETIME_TYPES):
                    found += [(c, "earliest", F.min(ref(c)).cast("timestamp_ntz")),
                              (c, "latest", F.max(ref(c)).cast("timestamp_ntz"))]
                if ("date" in c.lower() or "time" in c.lower()) and isinstance(types[c], T.StringType):
                    found.append((c, "n_bad_date", F.count_if(
                        ref(c).isNotNull() & to_time(ref(c), types[c]).isNull())))
            return found
        raise ValueError(f"unknown metric group: {group}")

    def need(self, *groups: str) -> "TableStats":
        missing = [g for g in dict.fromkeys(("nulls",) + groups) if g not in self._groups]
        wanted = [m for g in missing for m in self._metrics(g)]
        wanted.sort(key=lambda m: self.df.columns.index(m[0]))
        first = not self._groups
        if first and not wanted:
            self._n_rows = self.df.count()
        self._aggregate(wanted, count_rows=first)
        self._groups.update(missing)
        if "moments" in missing:
            for c in self.roles.numeric:
                self._derive_spread(self._facts[c])
        return self

    def _aggregate(self, wanted: list[tuple], count_rows: bool = False) -> None:
        """Work out (column, metric, expression) in scans of a few columns each and keep the results."""
        parts = [wanted[i:i + EXPRESSIONS_PER_SCAN] for i in range(0, len(wanted), EXPRESSIONS_PER_SCAN)]

        def scan(part: list[tuple], size: bool) -> None:
            rows = [F.count("*").alias("n_rows")] if size else []
            row = self.df.agg(*[e.alias(f"m{i}") for i, (_, _, e) in enumerate(part)], *rows).first()
            if size:
                self._n_rows = row["n_rows"]
            for i, (column, metric, _) in enumerate(part):
                self._facts[column][metric] = row[i]

        if parts:
            together(self.spark, [partial(scan, p, count_rows and i == 0) for i, p in enumerate(parts)])

    def _derive_spread(self, facts: dict) -> None:
        """Count and the deviations follow from the null count and one variance."""
        n, var = self._n_rows - facts["n_null"], facts["var_pop"]
        facts["n"] = n
        facts["std_pop"] = None if var is None else math.sqrt(var)
        facts["var_samp"] = None if var is None or n < 2 else var * n / (n - 1)
        facts["std_samp"] = None if facts["var_samp"] is None else math.sqrt(facts["var_samp"])

    def need_quantiles(self, *probs: float) -> "TableStats":
        self.need("nulls")
        if set(probs) & {0.25, 0.5, 0.75}:
            # operators that share these statistics want the others as well
            probs = tuple(sorted({*probs, 0.25, 0.5, 0.75}))
        left = [p for p in probs if any((c, p) not in self._quantiles for c in self.roles.numeric)]
        if left and self.roles.numeric:
            counts = {c: self._n_rows - self._facts[c]["n_null"] for c in self.roles.numeric}
            ends = {c: (f["min"], f["max"]) for c, f in self._facts.items() if "moments" in self._groups and c in self.roles.numeric}
            found = quantiles.exact_quantiles(self.df, {c: self.numeric(c) for c in self.roles.numeric}, counts, left,
                                              self.small_count, ends=ends)
            for c, values in found.items():
                for p, value in zip(left, values):
                    self._quantiles[c, p] = value
                    self._facts[c][f"q{p:g}"] = value
        return self

    def fences(self, threshold: float = 1.5) -> dict[str, tuple]:
        """Per numeric column with values (lower, upper) of the inter-quartile rule."""
        self.need_quantiles(0.25, 0.75)
        found = {}
        for c in self.roles.numeric:
            q1, q3 = self._quantiles[c, 0.25], self._quantiles[c, 0.75]
            if q1 is not None:
                found[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
        return found

    def need_outliers(self) -> "TableStats":
        """Counts outside the fences and beyond three population standard deviations, with their extremes."""
        if "outliers" not in self._groups:
            self.need("moments")
            wanted = []
            for c, (lower, upper) in self.fences().items():
                x = self.numeric(c)
                out = (x < lower) | (x > upper)
                z = F.abs(F.try_divide(x - F.lit(self._facts[c]["mean"]), F.lit(self._facts[c]["std_pop"])))
                self._facts[c].update(lower=lower, upper=upper)
                wanted += [(c, "n_outlier", F.count_if(out)), (c, "min_outlier", F.min(F.when(out, x))),
                           (c, "max_outlier", F.max(F.when(out, x))), (c, "n_z3", F.count_if(z > 3))]
            self._aggregate(wanted)
            self._groups.add("outliers")
        return self

    def need_cardinality(self, columns: list[str] | None = None, top: int = 0) -> "TableStats":
        """Distinct counts, and with `top` the most frequent values as well, from the same shuffle."""
        columns = [c for c in (columns if columns is not None else self.df.columns)
                   if ("n_unique" not in self._facts[c] or top > self._top_k.get(c, 0))
                   and frequencies.countable(self.roles.types[c])]
        if columns:
            if top:
                totals, best = frequencies.cardinality_and_top(self.df, columns, top)
            else:
                totals, best = [r.asDict() for r in frequencies.cardinality(self.df, columns).collect()], []
            for c in columns:
                self._facts[c].update(n_unique=0, top_count=None, low_count=None)
                if top:
                    self._top_k[c], self._top[c] = top, [r for r in best if r["column_name"] == c]
            for r in totals:
                self._facts[r["column_name"]].update(n_unique=r["n_unique"], top_count=r["top_count"],
                                                     low_count=r["low_count"])
        return self

    def top_values(self, columns: list[str], k: int) -> DataFrame:
        """(column_name, value_rank, value, cnt) of the k most frequent values."""
        self.need_cardinality(columns, top=k)
        return self.rows([r for c in columns for r in self._top.get(c, []) if r["value_rank"] <= k],
                         frequencies.TOP_SCHEMA)

    @cached_property
    def duplicate_rows(self) -> int:
        return duplicate_count(self.df)

    @cached_property
    def pairs(self) -> DataFrame:
        """(c1, c2, r) of the upper triangle, in column order."""
        return self.pairs_of(self.roles.numeric)

    def pairs_of(self, columns: list[str]) -> DataFrame:
        self.need("moments")
        known = {c: Moments(f["n"], f["mean"], f["var_pop"], f["min"] == f["max"])
                 for c, f in ((c, self._facts[c]) for c in columns)}
        return pair_correlations(self.df, self.n_rows, known, self.numeric)

    def gather(self, *wanted: str) -> "TableStats":
        """Statistics that need scans of their own, at the same time: quantiles, outliers, cardinality, duplicates, pairs."""
        jobs = {"quantiles": lambda: self.need_quantiles(0.5), "outliers": self.need_outliers,
                "cardinality": lambda: self.need_cardinality(self.roles.categorical, top=TOP_VALUES).need_cardinality(),
                "text_cardinality": lambda: self.need_cardinality(self.roles.categorical, top=TOP_VALUES),
                "duplicates": lambda: self.duplicate_rows, "pairs": lambda: self.pairs}
        self.need("moments")
        together(self.spark, [jobs[w] for w in wanted])
        return self

    def frame(self, metrics: list[str], columns: list[str] | None = None) -> DataFrame:
        """One row per column: position, column_name and the asked metrics."""
        names = self.df.columns if columns is None else columns
        rows = [{"position": self.df.columns.index(c), "column_name": c, **self._facts[c]} for c in names]
        schema = "position bigint, column_name string" + "".join(
            f", `{m}` {METRIC_TYPES.get(m, 'bigint' if m.startswith('n_') else 'double')}" for m in metrics)
        return small_frame(self.spark, rows, schema)

    def rows(self, rows: list[dict], schema: str) -> DataFrame:
        return small_frame(self.spark, rows, schema)
