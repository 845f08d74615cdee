"""One operator text, two engines: the few places where Spark SQL and ANSI/DuckDB SQL differ.

An operator is a function of a dialect that gives SQL over named inputs, written ``@name``.
Inputs are tables, stand-in views (views.py), or any DataFrame that a caller passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Text = Callable[["Dialect"], str]
INPUT = re.compile(r"@(\w+)")


class Dialect:
    """Spark SQL."""

    spark = True

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def replace_all(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by)})"

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_like({s}, {self.lit(pattern)})"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def extract_all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, {group})"

    def each(self, array: str, name: str, alias: str = "e") -> str:
        return f"LATERAL VIEW explode({array}) {alias} AS {name}"

    def each_at(self, array: str, at: str, name: str, alias: str = "e") -> str:
        """Elements with their place from 0."""
        return f"LATERAL VIEW posexplode({array}) {alias} AS {at}, {name}"

    def split(self, s: str, sep: str) -> str:
        return f"split({s}, {self.lit(re.escape(sep) if sep != chr(10) else chr(10))})"

    def series(self, a: str, b: str) -> str:
        return f"CASE WHEN {a} <= {b} THEN sequence({a}, {b}) ELSE array() END"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def join_rows(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {self.lit(sep)}) WITHIN GROUP (ORDER BY {order})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.lit(sep)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def at(self, array: str, k: str | int) -> str:
        """Element k from 1; null past the ends."""
        return f"try_element_at({array}, {k})"

    def slice(self, array: str, n: str | int) -> str:
        return f"slice({array}, 1, {n})"

    def filter(self, array: str, x: str, test: str) -> str:
        return f"filter({array}, {x} -> {test})"

    def map(self, array: str, x: str, expr: str) -> str:
        return f"transform({array}, {x} -> {expr})"

    def let(self, value: str, name: str, body: str) -> str:
        """The body with a value bound to a name: one evaluation, and nothing that moves the
        expression in a plan can multiply it."""
        return f"transform(array({value}), {name} -> {body})[0]"

    def distinct(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))"

    def common(self, a: str, b: str) -> str:
        return f"array_sort(array_intersect({a}, {b}))"

    def json(self, s: str, path: str) -> str:
        return f"get_json_object({s}, '$.{path}')"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def round_even(self, x: str) -> str:
        return f"bround({x})"

    def timestamp(self, s: str) -> str:
        return f"try_to_timestamp({s}, 'yyyy-MM-dd')"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)"


class Duck(Dialect):
    """DuckDB, which states the same results."""

    spark = False

    def lit(self, s):
        return "'" + s.replace("'", "''") + "'"

    def replace_all(self, s, pattern, by):
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(by.replace('$', chr(92)))}, 'g')"

    def matches(self, s, pattern):
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def extract(self, s, pattern, group=0):
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def each(self, array, name, alias="e"):
        return f"CROSS JOIN LATERAL (SELECT unnest({array}) AS {name}) {alias}"

    def each_at(self, array, at, name, alias="e"):
        return f"CROSS JOIN LATERAL (SELECT unnest({array}) AS {name}, generate_subscripts({array}, 1) - 1 AS {at}) {alias}"

    def split(self, s, sep):
        return f"string_split({s}, {self.lit(sep)})"

    def series(self, a, b):
        return f"generate_series({a}, {b})"

    def size(self, array):
        return f"CAST(len({array}) AS BIGINT)"

    def join_rows(self, x, sep, order):
        return f"string_agg({x}, {self.lit(sep)} ORDER BY {order})"

    def join(self, array, sep):
        return f"array_to_string({array}, {self.lit(sep)})"

    def array(self, *items):
        return f"[{', '.join(items)}]"

    def at(self, array, k):
        return f"({array})[{k}]"

    def slice(self, array, n):
        return f"({array})[1:{n}]"

    def filter(self, array, x, test):
        return f"list_filter({array}, lambda {x}: {test})"

    def map(self, array, x, expr):
        return f"list_transform({array}, lambda {x}: {expr})"

    def let(self, value, name, body):
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def distinct(self, array):
        return f"list_sort(list_distinct({array}))"

    def common(self, a, b):
        return f"list_sort(list_intersect({a}, {b}))"

    def json(self, s, path):
        return f"json_extract_string({s}, '$.{path}')"

    def sha256(self, s):
        return f"sha256({s})"

    def round_even(self, x):
        return f"round_even({x}, 0)"

    def timestamp(self, s):
        return f"try_strptime({s}, '%Y-%m-%d')"

    def median(self, x):
        return f"median({x})"


SPARK, DUCK = Dialect(), Duck()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Catalogue:
    """Named operators over named inputs."""

    def __init__(self) -> None:
        self.views: dict[str, Text] = {}
        self.texts: dict[str, Text] = {}
        self.frames: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.stated: dict[str, Text] = {}
        self.sql: dict[str, str] = {}

    def view(self, name: str) -> Callable[[Text], Text]:
        return lambda f: self.views.setdefault(name, f)

    def add(self, name: str, text: Text) -> None:
        """An operator that is a text in both dialects."""
        if name in self.texts or name in self.frames:
            raise ValueError(f"{name} stands twice")
        self.texts[name] = text

    def frame(self, name: str, oracle: Text | None = None):
        """An operator written with the DataFrame API, with SQL that states its result."""

        def put(f):
            if name in self.texts or name in self.frames:
                raise ValueError(f"{name} stands twice")
            self.frames[name] = f
            if oracle is not None:
                self.stated[name] = oracle
            return f

        return put

    def expand(self, text: Text) -> str:
        def put(m: re.Match) -> str:
            name = m[1]
            return name if name in TABLES else f"({self.expand(self.views[name])})"

        return INPUT.sub(put, text(DUCK))

    def load(self, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        if name in TABLES:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return self.run(spark, self.views[name], lambda n: self.load(spark, sf_dir, n))

    def run(self, spark: SparkSession, text: Text, source: Callable[[str], DataFrame]) -> DataFrame:
        """An operator's text over any inputs: source gives the DataFrame for a name."""
        sql = text(SPARK)
        names = dict.fromkeys(INPUT.findall(sql))
        sql = INPUT.sub(r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
        return spark.sql(sql, **{n: source(n) for n in names})

    def apply(self, name: str, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        """An operator over a caller's own tables, given by the names that its text reads."""
        return self.run(spark, self.texts[name], inputs.__getitem__)

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        made = {n: (lambda s, d, t=t: self.run(s, t, lambda x: self.load(s, d, x))) for n, t in self.texts.items()}
        return made | self.frames

    def oracle_sql(self) -> dict[str, str]:
        return {n: self.expand(t) for n, t in (self.texts | self.stated).items()} | self.sql


catalogue = Catalogue()
