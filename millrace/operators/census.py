"""A census of files: language and kind by path, rolled up, written as JSON and as a table of text, and read back."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query
from ..plans.storage import new_path
from ..sources import batches, multipart

# Extensions by language, and file names that have a language of their own.
EXTENSIONS = {
    "go": "go", "rust": "rs", "python": "py", "swift": "swift", "javascript": "js mjs", "typescript": "ts", "sql": "sql", "shader": "metal", "shell": "sh bash", "documentation": "md", "json": "json jsonl", "yaml": "yml yaml", "toml": "toml", "proto": "proto",
    "web": "html css svg webmanifest", "config": "xml plist sb mod dockerignore gitignore", "text": "txt", "binary": "png jpg jpeg webp pdf glb gltf onnx pt woff2 ttf ico br mp4 wasm gz", "lockfile": "lock sum resolved",
}
NAMES = {"Dockerfile": "config", "Makefile": "config", "Caddyfile": "config", "go.mod": "config", "Cargo.toml": "config", "cx": "shell"}
_OF = {x: lang for lang, some in EXTENSIONS.items() for x in some.split()}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column) -> Column:
    """The language that a path's extension (in any case) names, else its file name, else other; null for null."""
    base = base_name(path)
    extension = F.lower(F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1)))
    of = lambda known: F.create_map(*map(F.lit, chain.from_iterable(known.items())))
    return F.when(path.isNotNull(), F.coalesce(of(_OF)[extension], of(NAMES)[base], F.lit("other")))


def kind_of(path: Column) -> Column:
    """vendored, binary, test, documentation or maintained, the first that fits."""
    base, language = base_name(path), language_of(path)
    test = base.endswith("_test.go") | base.startswith("test_") | F.contains(path, F.lit("/tests/"))
    vendored = F.contains(path, F.lit("/vendor/")) | path.startswith("vendor/")
    return F.when(vendored, "vendored").when(language == "binary", "binary").when(test, "test").when(language == "documentation", "documentation").otherwise("maintained")


_ENDS = ["a.go", "b_test.go", "c.RS", "test_d.py", "e.tar.gz", "F.Md", "Makefile", "cx", "noext", ".gitignore", "g.", "h.mjs", "i.sql"]
_PATH = f"concat(CASE doc_id % 4 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'x/vendor/' WHEN 2 THEN 'x/tests/' ELSE '' END, source, '/', doc_id % 7, '/', CASE doc_id % {len(_ENDS)} {' '.join(f'''WHEN {i} THEN '{n}' ''' for i, n in enumerate(_ENDS))} END)"
_LANGUAGES = ["go", "go", "rust", "python", "binary", "documentation", "config", "shell", "other", "config", "other", "javascript", "sql"]
_FILES = f"""(SELECT *, CASE WHEN doc_id % 4 < 2 THEN 'vendored' WHEN language = 'binary' THEN 'binary' WHEN doc_id % 4 = 2 OR doc_id % {len(_ENDS)} IN (1, 3) THEN 'test' WHEN language = 'documentation' THEN 'documentation' ELSE 'maintained' END AS kind
    FROM (SELECT doc_id, text, {_PATH} AS path, CASE doc_id % {len(_ENDS)} {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_LANGUAGES))} END AS language FROM documents) p)"""


def tracked(e: Exchange) -> DataFrame:
    """doc_id, path, text: the documents as files."""
    return e.documents.select("doc_id", F.expr(_PATH).alias("path"), "text")


@query(f"SELECT doc_id, path, language, kind FROM {_FILES} f")
def fn_language_of(e: Exchange) -> DataFrame:
    return tracked(e).select("doc_id", "path", language_of(F.col("path")).alias("language"), kind_of(F.col("path")).alias("kind"))


def census(files: DataFrame) -> DataFrame:
    """language, kind, files, bytes, lines from path and text; a null text is an empty file."""
    text = F.coalesce("text", F.lit(""))
    lines = F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)
    per = files.groupBy(language_of(F.col("path")).alias("language"), kind_of(F.col("path")).alias("kind"))
    return per.agg(F.count("*").alias("files"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(lines).alias("lines"))


@query(f"SELECT language, kind, count(*) AS files, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, CAST(sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END) AS BIGINT) AS lines, concat('| ', language, ' | ', kind, ' | ', count(*), ' |') AS markdown FROM {_FILES} f GROUP BY language, kind")
def snk_census(e: Exchange) -> DataFrame:
    """The census written as JSON and as a Markdown table, both read back."""
    path, at = new_path(e.spark), new_path(e.spark)
    rolled = census(tracked(e))
    batches.publish(rolled, path, "census", "json")
    back = batches.published(e.spark, path, rolled.schema, "json").drop("batch")  # a row per language and kind
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "language", "kind", F.col("files").cast("string")), F.lit(" |\n"))
    head = e.spark.createDataFrame([("census", 0, "", "| language | kind | files |\n| --- | --- | --- |\n")], "key string, place int, by string, line string")
    lines = back.select(F.lit("census").alias("key"), F.lit(1).alias("place"), F.concat_ws("/", "language", "kind").alias("by"), row.alias("line"))
    multipart.write_ordered(head.union(lines).select("key", "place", "by", F.col("line").cast("binary").alias("data")), at, ["place", "by"])
    text = multipart.read_back(e.spark, at).select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("markdown")).where("markdown <> ''")
    cells = F.split("markdown", r" \| ")
    found = text.select("markdown", F.substring_index(F.get(cells, F.lit(0)), "| ", -1).alias("language"), F.get(cells, F.lit(1)).alias("kind"))
    return back.join(found, ["language", "kind"], "left").select("language", "kind", "files", "bytes", "lines", "markdown")
