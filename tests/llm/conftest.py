import pytest

#: Columns that clash with names the operators use inside.
EXTRA = "key string, value string, name string, size string, found string, fp string, label string, h string, score string"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table with clashing extra columns, in two partitions."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        for column in EXTRA.split(", "):
            df = df.selectExpr("*", f"'x' as {column.split()[0]}")
        return df.repartition(2)

    return make
