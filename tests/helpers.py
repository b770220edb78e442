"""Shared helpers: evaluate an expression on literal rows."""

from pyspark.sql import functions as F


def evaluate(spark, function, values, schema="value string"):
    """Results of ``function(column)`` for each value, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "row int, " + schema)
    return [r.out for r in df.select("row", function(F.col("value")).alias("out")).orderBy("row").collect()]


PDP_X = """{{Infobox computer
| name = PDP-X
| manufacturer = [[Digital Equipment Corporation|DEC]]
| release date = {{start date|1970}}
| bits = 16-bit
| cpu = Foo @ 1.5 [[Hertz|MHz]]
}}
The PDP-X was developed by [[Digital]] in 1971. It was released in March 1972 on 3 May 1973.
[[Category:Vacuum tube computers|x]] [[Category:Serial computers]]
"""

PDP_X_ATTRIBUTES = [
    ("company", "Digital Equipment Corporation"),
    ("release", "1970"),
    ("wordSize", "16"),
    ("clockSpeed", "1.5 MHz"),
    ("tech", "vacuum-tubes"),
    ("tech", "serial"),
    ("clockSpeed?", "1.5 MHz"),
    ("company?", "Digital"),
    ("release", "1971"),
    ("release?", "1972"),
    ("release?", "1973"),
]
