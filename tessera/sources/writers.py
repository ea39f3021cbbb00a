"""Writers: JSON, CSV, splits, crawl results in several formats, reports as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy("split").format(kind).save(path)


def write_processed(df: DataFrame, folder: str) -> None:
    """processed_<split>.json for each split, as JSON lines."""
    for row in df.select("split").distinct().collect():
        df.where(F.col("split") == row.split).drop("split").write.mode("overwrite").json(f"{folder}/processed_{row.split}.json")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_array(df: DataFrame, order_by: str) -> DataFrame:
    """One row: the table as one JSON array in order. For reports of bounded size."""
    item = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), item.alias("j")))), lambda s: s["j"]), ","), F.lit("]")).alias("json"))


def crawl_file_name(prefix: str, position: Column, at: Column, suffix: str) -> Column:
    return F.concat(F.lit(f"{prefix}_url_"), F.lpad(position.cast("string"), 2, "0"), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(suffix))


def crawl_markdown(url: Column, method: Column, content: Column) -> Column:
    return F.concat(F.lit("# "), url, F.lit("\n\n- method: "), method, F.lit("\n\n---\n\n"), content)


def crawl_outputs(results: DataFrame, prefix: str = "crawl", at: Column | None = None) -> DataFrame:
    """(file, body): html, markdown and JSON of each success; failures stand in the summary only."""
    at = F.current_timestamp() if at is None else at
    name = lambda suffix: crawl_file_name(prefix, F.col("position"), at, suffix)
    forms = F.array(
        F.struct(name(".html").alias("file"), F.col("html").alias("body")),
        F.struct(name(".md").alias("file"), crawl_markdown(F.col("url"), F.col("method"), F.col("content")).alias("body")),
        F.struct(name(".json").alias("file"), F.to_json(F.struct("url", "method", "content", "content_length")).alias("body")),
    )
    return results.where("success").select(F.explode(forms).alias("f")).select("f.file", "f.body")


def metadata_counts(pages: DataFrame, html: str = "html", text: str = "content") -> DataFrame:
    from ..operators.web import hrefs, image_sources

    h = F.col(html)
    return pages.select("*", F.length(h).alias("html_length"), F.length(text).alias("content_length"), F.size(hrefs(h)).alias("n_links"), F.size(image_sources(h)).alias("n_images"))


def html_report(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row with an HTML page, a block for each record in order."""
    block = F.concat(F.lit("<section>"), *[F.concat(F.lit(f"<h3>{c}</h3><p>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</p>")) for c in columns], F.lit("</section>"))
    return df.agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda s: s["b"]), "\n"), F.lit("</body></html>")).alias("html"))
