"""The few expressions that Spark SQL and the SQL of the oracle spell differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def days(a, b):
        return f"datediff({a}, {b})"

    @staticmethod
    def add_months(d, n):
        return f"add_months({d}, {n})"

    @staticmethod
    def add_days(d, n):
        return f"date_add({d}, CAST({n} AS INT))"

    @staticmethod
    def idiv(a, b):
        return f"({a} div {b})"

    @staticmethod
    def listed(x, where=None):
        return f"array_sort(collect_set({x}){f' FILTER (WHERE {where})' if where else ''})"

    @staticmethod
    def has(arr, x):
        return f"array_contains({arr}, {x})"

    @staticmethod
    def size(arr):
        return f"size({arr})"

    @staticmethod
    def overlap(a, b):
        return f"size(array_intersect({a}, {b}))"

    @staticmethod
    def union(a, b):
        return f"size(array_union({a}, {b}))"

    @staticmethod
    def array(*xs):
        return f"array({', '.join(xs)})"

    @staticmethod
    def unnest(table, arr, alias):
        return f"{table} LATERAL VIEW explode({arr}) t_{alias} AS {alias}"

    @staticmethod
    def months(table, lo, hi, alias):
        return f"{table} LATERAL VIEW explode(sequence({lo}, {hi}, interval 1 month)) t_{alias} AS {alias}"

    @staticmethod
    def quantile(x, q):
        return f"percentile({x}, {q})"

    @staticmethod
    def sha(x):
        return f"sha2({x}, 256)"

    @staticmethod
    def joined(x, order, sep=""):
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    @staticmethod
    def json(x, key):
        return f"get_json_object({x}, '$.{key}')"

    @staticmethod
    def matches(x, pattern):
        return f"({x} rlike '{pattern}')".replace("\\", "\\\\")

    @staticmethod
    def extract(x, pattern, group=0):
        return f"regexp_extract({x}, '{pattern}', {group})".replace("\\", "\\\\")

    @staticmethod
    def replace(x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', '{by}')".replace("\\", "\\\\")

    @staticmethod
    def hours(ts, n):
        return f"({ts} + make_interval(0, 0, 0, 0, CAST({n} AS INT)))"

    @staticmethod
    def seconds(a, b):
        return f"(unix_micros(CAST({a} AS TIMESTAMP)) - unix_micros(CAST({b} AS TIMESTAMP))) / 1000000.0"

    @staticmethod
    def month(d):
        return f"CAST(trunc({d}, 'MM') AS DATE)"


class Oracle:
    name = "oracle"

    @staticmethod
    def days(a, b):
        return f"CAST(date_diff('day', {b}, {a}) AS INT)"

    @staticmethod
    def add_months(d, n):
        return f"CAST({d} + INTERVAL ({n}) MONTH AS DATE)"

    @staticmethod
    def add_days(d, n):
        return f"({d} + CAST({n} AS INT))"

    @staticmethod
    def idiv(a, b):
        return f"({a} // {b})"

    @staticmethod
    def listed(x, where=None):
        return f"coalesce(list_sort(list(DISTINCT {x}) FILTER (WHERE {x} IS NOT NULL{f' AND {where}' if where else ''})), [])"

    @staticmethod
    def has(arr, x):
        return f"list_contains({arr}, {x})"

    @staticmethod
    def size(arr):
        return f"len({arr})"

    @staticmethod
    def overlap(a, b):
        return f"len(list_intersect({a}, {b}))"

    @staticmethod
    def union(a, b):
        return f"len(list_distinct(list_concat({a}, {b})))"

    @staticmethod
    def array(*xs):
        return f"[{', '.join(xs)}]"

    @staticmethod
    def unnest(table, arr, alias):
        return f"{table} CROSS JOIN LATERAL (SELECT unnest({arr}) AS {alias}) t_{alias}"

    @staticmethod
    def months(table, lo, hi, alias):
        return f"{table} CROSS JOIN LATERAL (SELECT CAST(unnest(generate_series({lo}, {hi}, INTERVAL 1 MONTH)) AS DATE) AS {alias}) t_{alias}"

    @staticmethod
    def quantile(x, q):
        return f"quantile_cont({x}, {q})"

    @staticmethod
    def sha(x):
        return f"sha256({x})"

    @staticmethod
    def joined(x, order, sep=""):
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    @staticmethod
    def json(x, key):
        return f"json_extract_string({x}, '$.{key}')"

    @staticmethod
    def matches(x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    @staticmethod
    def extract(x, pattern, group=0):
        return f"regexp_extract({x}, '{pattern}', {group})"

    @staticmethod
    def replace(x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    @staticmethod
    def hours(ts, n):
        return f"({ts} + INTERVAL ({n}) HOUR)"

    @staticmethod
    def seconds(a, b):
        return f"CAST(date_diff('microsecond', CAST({b} AS TIMESTAMP), CAST({a} AS TIMESTAMP)) AS DOUBLE) / 1000000.0"

    @staticmethod
    def month(d):
        return f"CAST(date_trunc('month', {d}) AS DATE)"
