"""Generated, minified, vendored and data files among source files, by a random forest.

Labels come from what such files say of themselves: notices in comments ("code generated by
..., do not edit", "imported unchanged from ...", release banners), and where a kind of file carries none, from
the names that tools give, the folders that builds write to, packages with foreign names below the folders of package managers, and contents
of which nearly every character stands in rows of numbers, records or encoded bytes.
The lines of the notices, the names and the share of data rows are hidden from the features. The forest sees what the
files look like (compression ratio, token entropy, identifier lengths, comment density, line
lengths and the like) and where they lie.

Files without a label may still belong to a class, so they are no safe negatives. Training
therefore takes three steps: a forest tells labelled files from the rest, the rest's files
that look like labelled ones are left out, twice, and the last forest is trained on what is
left. A file is reported if the last forest says so or, as an exact check, if it carries a notice itself.

Scale: features are sums per chunk that are added up per file, so no file is ever put
together in one place. The forests are fitted on at most ``max_train`` labelled rows drawn by
hash; notices, features and predictions cover every file.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import materialize, spread

#: What a comment line says, from its first word, if a tool made the file.
GENERATED = re.compile(
    r"(?ix)^(?: <auto-generated> | @generated\b | code\ generated\ by\b | auto-?generated\ (?:from|by|with|on)\b"
    r"| (?:this|the)\ (?:file|code|source)\ (?:is|was|has\ been)\ (?:auto(?:matically|-)?\s?)?(?:generated|produced|created|written)\ (?:by|from|with)\b"
    r"| (?:this\ file\ (?:is|was)\ )?automatically\ (?:generated|produced|created)\b | machine[-\ ](?:written|generated|made)\b"
    r"| generated\ (?:by|from|with)\b.*\b(?:do\ not|don't)\b | output\ of\ .*\b(?:overwritten|regenerated)\b"
    r"| automatisch\ (?:erzeugt|generiert|erstellt)\b | fichier\ (?:produit|g.n.r.)\ (?:par|automatiquement)\b | g.n.r.\ (?:par|automatiquement)\b"
    r"| (?:archivo|fichero)\ generado\b | generado\ (?:por|autom.ticamente)\b )"
)
#: The same for files taken over from others.
VENDORED = re.compile(
    r"(?ix)^(?: (?:copied|imported|vendored|taken|borrowed|adopted)\ (?:(?:unchanged|verbatim|as\ is)\ )?from\ (?:https?:|project\b|upstream\b|the\ upstream\b|package\b|\S+\ v?\d)"
    r"| .*\b(?:upstream|unmodified|unchanged|verbatim)\ copy\b.*\b(?:https?:|source\b) | !?\ ?[\w.@/-]+\ v?\d[\w.]*\ \|\ (?:\(c\)|copyright)\ .*\|.*\blicen[cs]e"
    r"| \S+\ -\ single-header\ library\b | (?:bundled|vendored)\ copy\ of\b | third[-\ ]party\ (?:code|library|source)\b.*\b(?:from|by|unchanged)\b )"
)
_COMMENT = re.compile(r"^\s*(?://+!?|\#+!?|/\*+!?|\*+|--|;+|<!--|%+)\s*(.*?)\s*(?:\*/|-->)?\s*$")
#: Folders of package managers and of copied packages.
VENDOR_FOLDERS = r"(?i)/(?:vendor|vendors|vendored|third[-_]?part(?:y|ies)|3rd[-_]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|externals?|extern|deps|dependencies|pods|carthage|godeps)/"
BUILD_FOLDERS = r"(?i)/(?:gen|generated|__generated__|autogen|build|dist|target|out)/"
TOOL_NAMES = r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|c|js|ts)|grpc(?:_auto)?\.java|\.g\.[a-z]+|\.gen\.[a-z]+|\.generated\.[a-z]+|[._-]generated\.[a-z]+|_auto\.[a-z]+|\.tab\.[ch]|\.designer\.[a-z]+)$"
MINIFIED_NAMES = r"(?i)(?:[.-]min\.[a-z]+|[.-](?:bundle|chunk)\.[a-z]+|\.[0-9a-f]{4,}\.(?:js|mjs|cjs|jsx|css|ts|tsx))$"

#: Words that at least this share of the paths outside of such folders has are the corpus's own, and no names of packages.
OWN_WORDS = 0.001

_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_ROW = re.compile(r"^[\s\[\](){},;:|+\-.\dxXeE\"'a-fA-F]*$")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_NUMBER = re.compile(r"\d")
_DIGITS, _BLANKS = np.arange(48, 58), np.array([9, 10, 11, 12, 13, 32])
_LETTERS = np.concatenate([np.arange(65, 91), np.arange(97, 123), np.arange(128, 256)])

SUMS = [
    "chunks", "chars", "packed", "raw", "tokens", "entropy", "names", "name_chars", "short_names", "lines", "comments", "digits", "letters", "blanks",
    "shapes", "encoded", "data_chars", "kinds",
]


def notice_of(line: str) -> str | None:
    """``generated`` or ``vendored`` if a line is a comment that says so, else null."""
    m = _COMMENT.match(line)
    if not m or not m.group(1):
        return None
    return "generated" if GENERATED.match(m.group(1)) else "vendored" if VENDORED.match(m.group(1)) else None


def _is_data(line: str) -> bool:
    """A row of numbers, a record of delimited fields, or encoded bytes."""
    t = line.strip()
    if not t:
        return False
    if _ENCODED.search(t) and sum(map(len, _ENCODED.findall(t))) >= 0.6 * len(t):
        return True
    digits = len(_NUMBER.findall(t))
    if digits >= 2 and _ROW.match(t):
        return True
    for sign in (";", "\t", "|", ","):
        fields = t.split(sign)
        if len(fields) >= 4 and "(" not in t and "{" not in t and sum(bool(_NUMBER.match(f.strip() or "x")) for f in fields) >= 2:
            return True
    return False


def chunk_features(text: str) -> tuple[list[float], float, str | None]:
    """The sums of one chunk, its longest line, and the notice it carries (which the sums leave out)."""
    notice, lines = None, []
    for line in text.split("\n"):
        found = notice_of(line)
        if found:
            notice = notice or found
        else:
            lines.append(line)
    body = "\n".join(lines)
    raw = body.encode("utf-8", "replace")
    tokens = _TOKEN.findall(body)
    count = Counter(tokens)
    n = len(tokens)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values()) if n else 0.0
    names = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    full = [x for x in lines if x.strip()]
    shapes = {re.sub(r"[^\W\d]\w*", "a", re.sub(r"\d[\w.]*", "9", x.strip())) for x in full}
    encoded = sum(map(len, _ENCODED.findall(body)))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)  # bytes beyond ASCII count as letters
    data = sum(len(x) for x in full if _is_data(x))
    sums = [
        1.0, len(body), len(zlib.compress(raw, 6)) if raw else 0, len(raw), n, n * entropy, len(names), sum(map(len, names)), sum(len(t) <= 2 for t in names), len(full),
        sum(bool(_COMMENT.match(x)) for x in full), seen[_DIGITS].sum(), seen[_LETTERS].sum(), seen[_BLANKS].sum(), len(shapes), encoded, data, len(count),
    ]
    return [float(x) for x in sums], float(max(map(len, lines), default=0)), notice


def file_features(chunks: DataFrame) -> DataFrame:
    """One row per file that holds source code: sums, longest line and notices, added up over its chunks.

    Rows without a path or content and chunks whose type is not ``code:...`` are left out;
    repeated rows of a chunk count once; a null chunk id counts as a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [chunk_features(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([g[0][i] for g in got], pa.float64()) for i in range(len(SUMS))]
            longest, notice = pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, longest, notice], ["path", "id", *SUMS, "longest", "notice"])

    rows = chunks.where(F.col("content_type").startswith("code:") & F.col("file_path").isNotNull() & F.col("content").isNotNull())
    rows = rows.select(F.col("file_path").cast("string").alias("path"), F.coalesce(F.col("chunk_id").cast("string"), F.sha2("content", 256)).alias("id"), "content")
    each = spread(rows).mapInArrow(run, "path string, id string, " + ", ".join(f"{s} double" for s in SUMS) + ", longest double, notice string")
    each = each.groupBy("path", "id").agg(*(F.max(s).alias(s) for s in [*SUMS, "longest", "notice"]))
    files = each.groupBy("path").agg(
        *(F.sum(s).alias(s) for s in SUMS), F.max("longest").alias("longest"),
        F.max((F.col("notice") == "generated").cast("int")).alias("says_generated"), F.max((F.col("notice") == "vendored").cast("int")).alias("says_vendored"),
    )
    return files


def foreign_packages(paths: DataFrame) -> DataFrame:
    """``(path)`` of files below a package folder whose name has a word that paths elsewhere hardly have.

    ``vendors/`` or ``dependencies/`` may be a module of one's own, whose folders are named with
    the words of the corpus; a package taken over brings its own name.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != ""))
    paths = paths.select("path").where(F.col("path").isNotNull()).distinct()
    inside = F.col("path").rlike(VENDOR_FOLDERS)
    elsewhere = paths.where(~inside)
    common = elsewhere.select(F.explode(words(F.col("path"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    least = elsewhere.agg(F.greatest(F.lit(2.0), F.count("*") * OWN_WORDS).alias("least"))  # one row
    common = common.crossJoin(F.broadcast(least)).where(F.col("n") >= F.col("least")).select("word", F.lit(True).alias("own"))
    package = F.regexp_extract("path", VENDOR_FOLDERS + "([^/]+)/", 1)
    named = paths.where(inside).select("path", F.explode(words(package)).alias("word")).join(common, "word", "left")
    return named.where(F.col("own").isNull()).select("path").distinct()


def label() -> Column:
    """The reason to count a file among the foreign ones for training, or null."""
    return (
        F.when((F.col("says_generated") == 1) | (F.col("build_folder") == 1) | (F.col("tool_name") == 1), "generated")
        .when((F.col("says_vendored") == 1) | (F.col("package") == 1), "vendored")
        .when(F.col("minified_name") == 1, "minified")
        .when(F.col("data_chars") >= 0.8 * F.greatest(F.col("raw") - F.col("blanks"), F.lit(1)), "data")
    )


FEATURES = [
    "compression", "token_entropy", "name_length", "short_names_share", "comment_density", "line_length", "longest_line", "digit_share", "letter_share", "blank_share",
    "shape_share", "encoded_share", "vocabulary", "generic_type", "build_folder", "package",
]


def with_ratios(files: DataFrame) -> DataFrame:
    one = lambda c: F.greatest(F.col(c), F.lit(1.0))
    ratios = {
        "compression": F.col("packed") / one("raw"), "token_entropy": F.col("entropy") / one("tokens"), "name_length": F.col("name_chars") / one("names"),
        "short_names_share": F.col("short_names") / one("names"), "comment_density": F.col("comments") / one("lines"), "line_length": F.log1p(F.col("chars") / one("lines")),
        "longest_line": F.log1p("longest"), "digit_share": F.col("digits") / one("raw"), "letter_share": F.col("letters") / one("raw"), "blank_share": F.col("blanks") / one("raw"),
        "shape_share": F.col("shapes") / one("lines"), "encoded_share": F.col("encoded") / one("chars"), "vocabulary": F.col("kinds") / one("tokens"),
    }
    return files.withColumns(ratios)


def held_out(part: int) -> Column:
    return F.pmod(F.xxhash64("path", F.lit(part)), F.lit(part)) == 0


def find_foreign_files(chunks: DataFrame, files: DataFrame, max_train: int = 20_000, trees: int = 24, depth: int = 7, min_vote: float = 0.5, seed: int = 17, hold: int | None = None) -> DataFrame:
    """``(path, reason, notice, probability, found)`` of every file that holds source code.

    ``reason`` is the label for training (generated, vendored, minified, data) or null, ``notice`` whether a notice gave it,
    ``probability`` the forest's vote, ``found`` whether the vote is at least ``min_vote`` or the file carries a notice. ``max_train``
    bounds the rows that each forest is fitted on; one file in ``hold`` is kept out of training. With fewer than ten labelled or unlabelled
    files there is no forest and the labels decide; no code gives an empty result.
    """
    mime = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by("mime_type", F.struct(F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp")), "modified_at")).alias("mime"))
    code = materialize(with_ratios(file_features(chunks)), "hw-features")
    flag = lambda pattern: F.col("path").rlike(pattern).cast("double")
    rows = code.join(mime, "path", "left").join(foreign_packages(code).withColumn("package", F.lit(1.0)), "path", "left").fillna({"package": 0.0})
    rows = rows.withColumns({"build_folder": flag(BUILD_FOLDERS), "tool_name": flag(TOOL_NAMES), "minified_name": flag(MINIFIED_NAMES)}).withColumn("reason", label())
    generic = F.coalesce(F.col("mime").isin("text/plain", "application/octet-stream", ""), F.lit(True)).cast("double")
    notice = (F.col("says_generated") == 1) | (F.col("says_vendored") == 1)
    rows = rows.withColumn("generic_type", generic).withColumn("labelled", F.col("reason").isNotNull().cast("double"))
    rows = materialize(rows.select("path", "reason", F.coalesce(notice, F.lit(False)).alias("notice"), "labelled", *FEATURES), "hw-files")
    tally = {r.labelled: r["count"] for r in rows.groupBy("labelled").count().collect()}
    n = sum(tally.values())
    if min(tally.get(0.0, 0), tally.get(1.0, 0)) < 10:
        return rows.select("path", "reason", "notice", F.lit(None).cast("double").alias("probability"), F.col("reason").isNotNull().alias("found"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)
    share = max(1, -(-n // max_train))
    sample = vectors.where(F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(share)) == 0)
    if hold is not None:
        sample = sample.where(~held_out(hold))

    def forest(train: DataFrame):
        return RandomForestClassifier(labelCol="labelled", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="0.5", seed=seed, maxBins=64).fit(train.select("features", "labelled"))

    usual = tally[1.0] / n
    vote = vector_to_array("probability")[1]
    train = sample.select("path", "features", "labelled")
    for _ in range(2):  # leave out unlabelled files that look like labelled ones
        suspect = forest(train).transform(sample.select("path", "features", "labelled"))
        train = materialize(suspect.where((F.col("labelled") == 1) | (vote <= 1.5 * usual)).select("path", "features", "labelled"), "hw-train")
    out = forest(train).transform(vectors).withColumn("vote", vote)
    return out.select("path", "reason", "notice", F.round("vote", 6).alias("probability"), (F.col("notice") | (F.col("vote") >= min_vote)).alias("found"))


def held_out_accuracy(chunks: DataFrame, files: DataFrame, part: int = 4) -> DataFrame:
    """One row about files kept out of training: how many have a label without a notice and the share of them the vote finds,
    how many have none and the share found of these, and the mean vote of files whose label only a notice gave.
    """
    rows = find_foreign_files(chunks, files, hold=part).where(held_out(part))
    mark = F.col("reason").isNotNull() & ~F.col("notice")
    share = lambda which, what: F.round(F.avg(F.when(which, what)), 4)
    found = F.col("found").cast("double")
    return rows.agg(
        F.count_if(mark).alias("marked"), share(mark, found).alias("marked_found"), F.count_if(F.col("reason").isNull()).alias("unmarked"), share(F.col("reason").isNull(), found).alias("unmarked_found"),
        F.count_if(F.col("notice")).alias("with_notice"), share(F.col("notice"), F.col("probability")).alias("vote_on_notice"),
    )
