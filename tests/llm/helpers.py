"""Small document tables with every awkward case."""

AWKWARD = [None, "", " ", "\n\n", "one", "One one", "é　日本 \x00 😀", "a" * 5000, "the cat sat\nthe cat sat\n" * 40, "x \x0b y\x0cz\r\nq\tr"]


def documents(spark, texts, first=1):
    rows = [(first + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def store(df, tmp_path, name="documents"):
    path = f"{tmp_path}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return str(tmp_path)
