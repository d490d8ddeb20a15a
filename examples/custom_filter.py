"""A filter of one's own: links to one site go to its mirror, and quotes that hold nothing but a quote lose a level.

    python examples/custom_filter.py FOLDER
"""

import sys

from pyspark.sql import SparkSession

from leafmill.operators import filters
from leafmill.operators.convert import Engine, files

mirror = filters.replace_link_target(lambda url: url.replace("https://old.example.org/", "https://new.example.org/"))
single = filters.tree_filter(lambda b, above: filters.UNWRAP if b.tag == "quote" and above and above[-1].tag == "quote" and len(above[-1].kids) == 1 else filters.KEEP)

if __name__ == "__main__":
    spark = SparkSession.builder.appName("custom filter").getOrCreate()
    out = Engine().convert(files(spark, sys.argv[1]), filters=[filters.pipeline(mirror, single, filters.shift_headings(1))])
    for r in out.select("name", "status", "markdown").toLocalIterator():
        print(f"--- {r['name']} ({r['status']})\n{r['markdown'] or ''}")
