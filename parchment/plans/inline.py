"""Small tables written out in queries: the same rows for Spark and for SQL, so that odd values reach rules that the test tables do not try."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, dict):
        return "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in value.items()) + "}"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


class Rows:
    """Rows with a Spark schema and, for SQL, the same as a SELECT over VALUES."""

    def __init__(self, schema: str, rows: Sequence[tuple]):
        self.schema, self.rows = schema, list(rows)
        self.names = [part.split()[0] for part in schema.split(", ") if " " in part and "<" not in part.split()[0]]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {values}) v({', '.join(f'"{n}"' for n in self.names)}))"


class Beside:
    """Rows of a given table, and beside them rows written out: columns by expressions that both dialects read alike, or by a pair of them (Spark, SQL)."""

    def __init__(self, rows: Rows, table: str, *columns: str | tuple[str, str]):
        self.rows, self.table, self.columns = rows, table, [x if isinstance(x, tuple) else (x, x) for x in columns]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        own = self.rows.frame(spark)
        given = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return own.unionByName(given.selectExpr(*(f"cast({e} as {f.dataType.simpleString()}) as `{f.name}`" for (e, _), f in zip(self.columns, own.schema, strict=True))))

    @property
    def sql(self) -> str:
        return f"(SELECT * FROM {self.rows.sql} UNION ALL SELECT {', '.join(e for _, e in self.columns)} FROM {self.table})"


#: White space that browsers know and regular expressions do not, invisible signs, ligatures, curly signs, hyphens at line breaks.
ODD_TEXTS = Rows("doc_id long, text string", [
    (-1, ""), (-2, "   \t\n "), (-3, "Foo.\n"), (-4, "\u00a0wide\u2003blanks\u3000here\ufeff"), (-5, "cardio-\nvascular and well-\nBeing"), (-6, "e\ufb03cient \ufb01n \u201cquoted\u201d \u2018it\u2019s\u2019 a—b\u2026"),
    (-7, "zero\u200bwidth so\u00adft"), (-8, "a \u200b b"), (-9, "# Head\n\n- **bold** `code`\n\n[link](http://x.y) _it_"), (-10, "line one\r\n\u00a0\r\nline three\u2028same"), (-11, "UPPER lower The the THE"), (-12, "one two. Three? \"Four!\" "),
    (-13, "x < y & z > w"), (-14, "it's o'clock - don't; 12.5 'q'"), (-15, "end,;:. "), (-16, "\u0391\u03b2 \u4e2d\u6587 café cafe\u0301"), (-17, "\u0130 the end\n\n \nof The line\n "), (-18, "He said \"Hi!\" Then left.'  "), (-19, "No stop.\"' here"), (-20, "two  blanks   only")])
