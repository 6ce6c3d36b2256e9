"""Where Spark SQL and DuckDB spell the same expression differently. A catalog operator is one query shape; the driver
checks the Spark plan made from it against the same shape on the other engine."""

from __future__ import annotations


class Spark:
    name = "spark"
    text = "STRING"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def table(self, t):
        return f"parquet.`{self.sf_dir}/{t}.parquet`"

    def bytes(self, x):
        return f"CAST(octet_length({x}) AS BIGINT)"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def split(self, x, sep="/"):
        return f"split({x}, '{sep}')"

    def size(self, a):
        return f"CAST(size({a}) AS BIGINT)"

    def first_n(self, a, n):
        return f"slice({a}, 1, CAST({n} AS INT))"

    def at(self, a, i):
        return f"element_at({a}, CAST({i} AS INT))"

    def join(self, a, sep="/"):
        return f"array_join({a}, '{sep}')"

    def div(self, a, b):
        return f"(({a}) div ({b}))"

    def rlike(self, x, p):
        return f"({x} RLIKE r'{p}')"

    def sub(self, x, p, r):
        return f"regexp_replace({x}, r'{p}', '{r}')"

    def extract(self, x, p, g=0):
        return f"regexp_extract({x}, r'{p}', {g})"

    def prefixes(self, a, low=1, drop=0):
        """Rows of the path prefixes of an array of names, as a generator expression."""
        return f"explode(transform(sequence({low}, size({a}) - {drop}), i -> array_join(slice({a}, 1, i), '/')))"

    def numbers(self, n):
        return f"explode(sequence(1, {n}))"

    def strftime(self, seconds, fmt):
        java = {"%Y-%m": "yyyy-MM", "%Y-%m-%d": "yyyy-MM-dd", "%Y%m%d%H%M.%S": "yyyyMMddHHmm.ss"}[fmt]
        return f"date_format(timestamp_seconds({seconds}), '{java}')"

    def sorted_list(self, x):
        return f"sort_array(collect_list({x}))"

    def epoch(self, ts):
        return f"unix_seconds(CAST({ts} AS TIMESTAMP))"

    def lpad(self, x, n):
        return f"lpad(CAST({x} AS STRING), {n}, '0')"

    def position(self, x, needle):
        return f"CAST(instr({x}, '{needle}') AS BIGINT)"


class Duck:
    name = "duck"
    text = "VARCHAR"

    def table(self, t):
        return t

    def bytes(self, x):
        return f"CAST(strlen({x}) AS BIGINT)"

    def sha(self, x):
        return f"sha256({x})"

    def split(self, x, sep="/"):
        return f"string_split({x}, '{sep}')"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def first_n(self, a, n):
        return f"({a})[1:{n}]"

    def at(self, a, i):
        return f"({a})[{i}]"

    def join(self, a, sep="/"):
        return f"array_to_string({a}, '{sep}')"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def rlike(self, x, p):
        return f"regexp_matches({x}, '{p}')"

    def sub(self, x, p, r):
        return f"regexp_replace({x}, '{p}', '{r.replace('$', chr(92))}', 'g')"

    def extract(self, x, p, g=0):
        return f"regexp_extract({x}, '{p}', {g})"

    def prefixes(self, a, low=1, drop=0):
        return f"unnest(list_transform(range({low}, len({a}) - {drop} + 1), lambda i: array_to_string(({a})[1:i], '/')))"

    def numbers(self, n):
        return f"unnest(range(1, {n} + 1))"

    def strftime(self, seconds, fmt):
        return f"strftime(to_timestamp({seconds}) AT TIME ZONE 'UTC', '{fmt}')"

    def sorted_list(self, x):
        return f"list_sort(list({x}))"

    def epoch(self, ts):
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def lpad(self, x, n):
        return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"

    def position(self, x, needle):
        return f"CAST(instr({x}, '{needle}') AS BIGINT)"
