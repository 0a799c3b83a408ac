"""Secret scan: candidate strings, and a random forest that removes false positives.

Native: DataFrame functions and Spark's own forest; no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: characters of a candidate and its least length
CLASS, LEAST = "A-Za-z0-9+/_-", 16
#: names that a secret of any form and length is assigned to, and what may stand between; the password of a url's user
NAMES = "password|passwd|pwd|passphrase|secret|token|api_?key|access_?key|private_?key"
#: a lookbehind needs bounds: blanks on a side of an assignment, and characters of a url's user
BLANKS, USER = 16, 256
GIVEN = (rf"(?<=[=:>\"'\s])(?=[^\s\"'=>])(?<=[=:>][ \t]{{0,{BLANKS}}}[\"']?)(?i)(?<=(?:{NAMES})[\"']?[ \t]{{0,{BLANKS}}}(?::=|=>|==?|:)[ \t]{{0,{BLANKS}}}[\"']?)"
         rf"|(?<=:)(?<=://[^\s/:@?#]{{0,{USER}}}:)(?=[^\s/@]+@)")
#: characters of context kept on either side; pieces of text that surely hold them, as candidates begin 3 characters apart or more
CONTEXT, NEAR = 80, 32
#: pieces to a block of running lengths
SPAN = 256
FEATURES = ["f_length", "f_digits", "f_upper", "f_symbols", "f_switches", "f_chars", "f_dictionary", "f_slashes", "f_url", "f_path",
            "f_before", "f_after", "f_assigned", "f_quoted"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, start, candidate, left, right, path): every run of 16 or more of A-Za-z0-9+/_- of every whole text, and every
    value given to a secret's name, with padding.

    A value is the non-blank run, of any length, after a name like password and an assignment (with at most BLANKS
    blanks on a side), without its quotes, punctuation at its end, or further parameters of a url; or the password of a
    url's user (of at most USER characters). A run that begins where a value does is one candidate with it. ``start`` is the
    place of its first character in the text, from 0; ``left`` and ``right`` are the CONTEXT characters beside it.
    The text is cut once before each candidate of a form. Places are running lengths by blocks of SPAN pieces, so the
    work is linear in the text and, up to some hundred thousand candidates of one text, in these.
    """
    def held(df: DataFrame, **columns: Column) -> DataFrame:
        """Columns that pass a generator, so that they are computed once a row and not once an element that uses them."""
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))

    def upto(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def sums(sizes: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / SPAN).cast("int")), lambda b: upto(F.slice(F.col(sizes), b * SPAN + 1, F.lit(SPAN))))

    def offsets(blocks: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: upto(F.slice(F.col(blocks), F.lit(1), b)))

    def pieces(cut: str, sizes: str, before: str, run: bool) -> Column:
        block = lambda i: F.floor(i / SPAN).cast("int")
        start = lambda i: F.get(before, block(i)) + upto(F.slice(F.col(sizes), block(i) * SPAN + 1, i % SPAN)) - 1
        tails = lambda i: F.transform(F.slice(F.col(cut), F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR))), lambda x: F.substring(x, -CONTEXT, CONTEXT))
        heads = lambda i: F.transform(F.slice(F.col(cut), i + 2, F.lit(NEAR)), lambda x: F.substring(x, 1, CONTEXT))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(cut) - 1), lambda i: i > 0), lambda i: F.struct(
            start(i).alias("start"), F.lit(run).alias("run"), F.get(cut, i).alias("piece"),
            F.substring(F.array_join(tails(i), ""), -CONTEXT, CONTEXT).alias("left"), F.substring(F.array_join(heads(i), ""), 1, CONTEXT).alias("next")))

    path = F.col(path_col) if path_col and path_col in docs.columns else F.lit(None)
    text = F.concat(F.lit(" "), F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.cast("string").alias("path"))
    rows = held(rows.where("text is not null"), runs=F.split(text, f"(?<![{CLASS}])(?=[{CLASS}]{{{LEAST},}})"), given=F.split(text, GIVEN)).drop("text")
    rows = held(rows.where((F.size("runs") > 1) | (F.size("given") > 1)), **{f"{c}_sizes": F.transform(c, lambda x: F.length(x).cast("long")) for c in ("runs", "given")})
    rows = held(rows, **{f"{c}_sums": sums(f"{c}_sizes") for c in ("runs", "given")})
    rows = held(rows, **{f"{c}_before": offsets(f"{c}_sums") for c in ("runs", "given")})
    every = [pieces(c, f"{c}_sizes", f"{c}_before", c == "runs") for c in ("runs", "given")]
    rows = held(rows, all=F.sort_array(F.concat(*every))).select("id", "path", "all")
    once = F.filter("all", lambda x, i: (i == 0) | (x["start"] != F.get("all", i - 1)["start"]))  # a value stands before a run
    found = rows.select("id", "path", F.explode(once).alias("c")).select("id", "path", "c.*")
    end = ",;.)\\]}>\"'"
    value = (F.when(F.col("left").endswith('"'), F.regexp_extract("piece", r'^[^\s"]+', 0)).when(F.col("left").endswith("'"), F.regexp_extract("piece", r"^[^\s']+", 0))
             .when(F.col("left").rlike(r"://[^\s/:@?#]*:$"), F.regexp_extract("piece", r"^[^\s/]+(?=@)", 0))
             .when(F.col("left").rlike(r"[?&][^\s?&]*=$"), F.regexp_extract("piece", r"^[^\s&#]+", 0))
             .otherwise(F.regexp_replace(F.regexp_extract("piece", r"^\S+", 0), f"(?<=[^{end}])[{end}]+$", "")))
    hit = F.when(F.col("run"), F.regexp_extract("piece", f"^[{CLASS}]+={{0,2}}", 0)).otherwise(value)
    return (found.withColumn("candidate", hit).where("candidate <> ''")
            .select("id", "start", "candidate", "left", F.expr(f"substring(concat(substring(piece, length(candidate) + 1, {CONTEXT}), next), 1, {CONTEXT})").alias("right"), "path"))


def folded(c: Column) -> Column:
    """Characters folded to classes: a digit to 0, an upper-case letter to A, a symbol to +; lower-case ones stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[A-Z]", "A"), "[^a-z0A]", "+")


def word_before(left: Column) -> Column:
    return F.lower(F.regexp_extract(left, r"([A-Za-z]{2,})[^A-Za-z]*$", 1))


def word_after(right: Column) -> Column:
    return F.lower(F.regexp_extract(right, r"^[^A-Za-z]*([A-Za-z]{2,})", 1))


def _odds(labelled: DataFrame, key: str, least: int = 5) -> DataFrame:
    """(key, odds): log odds of a finding being a secret given the key, against all findings; 0 for rare keys.

    No larger than the bounded labelled findings it is made of.
    """
    by = labelled.groupBy(key).agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
    total = labelled.agg(F.avg("label").alias("p")).first().p or 0.0
    p = min(max(total, 1e-3), 1 - 1e-3)
    share = (F.col("yes") + 2 * p) / (F.col("n") + 2)
    return by.where(F.col("n") >= least).select(F.col(key).alias("key"), (F.log(share / (1 - share)) - math.log(p / (1 - p))).alias("odds"))


def dictionary(docs: DataFrame, text_col: str = "text", least: int = 5) -> DataFrame:
    """(word): letter words of 3 letters or more, lower-cased, that occur at least ``least`` times in all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[a-z]{3,}"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def features(found: DataFrame, labelled: DataFrame, words: DataFrame) -> DataFrame:
    """Add the forest's features to candidates that have a unique ``key``.

    Length, shares of character classes and switches between them; the mean log odds of character
    transitions (folded to 29 classes, so 841 at most) in labelled secrets against other findings; the share
    of the candidate that dictionary words cover; slashes, a url or path around it, the odds of its path;
    the odds of the words beside it; an assignment or quote before it.
    """
    size = F.length("candidate")
    share = lambda what: F.regexp_count("candidate", F.lit(what)) / size
    pairs = lambda df: df.withColumn("f", folded(F.col("candidate"))).select(
        *[c for c in ("key", "label") if c in df.columns], F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.length("f") - 1), lambda i: i > 0), lambda i: F.substr("f", i, F.lit(2)))).alias("pair"))
    yes = F.sum("label")
    moves = pairs(labelled).groupBy("pair").agg(yes.alias("yes"), (F.count("*") - yes).alias("no"))
    total = moves.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    ratio = F.log((F.col("yes") + 1) / float((total.yes or 0) + 841)) - F.log((F.col("no") + 1) / float((total.no or 0) + 841))
    chars = pairs(found).join(F.broadcast(moves.select("pair", ratio.alias("worth"))), "pair", "left").groupBy("key").agg(F.avg(F.coalesce("worth", F.lit(0.0))).alias("f_chars"))
    runs = found.select("key", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    covered = runs.join(words, "word").groupBy("key").agg(F.sum(F.length("word")).alias("covered"))
    out = (found.withColumns({
        "f_length": F.log(size.cast("double")), "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_symbols": share("[+/_=-]"),
        "f_switches": share("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"), "f_slashes": share("/"),
        "f_url": F.col("left").rlike(r"(://|\bwww\.|/)\S*$").cast("double"), "f_assigned": F.col("left").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "f_quoted": F.col("left").rlike(r"[\"']$").cast("double"), "before": word_before(F.col("left")), "after": word_after(F.col("right"))})
        .join(chars, "key", "left").join(covered, "key", "left")
        .withColumn("f_dictionary", F.coalesce(F.col("covered"), F.lit(0)) / size))
    named = labelled.withColumns({"before": word_before(F.col("left")), "after": word_after(F.col("right"))})
    for name, column in (("f_path", "path"), ("f_before", "before"), ("f_after", "after")):
        table = F.broadcast(_odds(named, column).withColumnRenamed("odds", name).withColumnRenamed("key", f"_{name}"))
        out = out.join(table, F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out.fillna(0.0, [f for f in FEATURES])


def known_form() -> Column:
    """Whether a finding is a cloud access key id, or hexadecimal assigned to a name like password or token."""
    return F.col("candidate").rlike(r"^AKIA[0-9A-Z]{16}$") | (F.col("candidate").rlike(r"^[0-9a-f]{18,}$") & F.col("left").rlike(r"(?i)(password|passwd|secret|token|api_?key)\W{1,4}$"))


def seed_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where no reviewed ones are at hand: (id, start, label).

    A finding with a known form is a secret (see ``known_form``). One of letters alone in the case of ordinary
    words is none, nor are words and short numbers in a url's path. All others stay unlabelled, for the forest to judge.
    """
    words = F.col("candidate").rlike(r"^[/_+-]*([A-Z]?[a-z]+|[0-9]{1,4})([/_+-]+([A-Z]?[a-z]+|[0-9]{1,4}))*[/_+-]*$")
    plain = F.col("candidate").rlike(r"^[A-Z]?[a-z]+$") | (F.col("left").rlike(r"://[^\s?#]*$") & words)
    return found.select("id", "start", F.when(known_form(), 1).when(plain, 0).alias("label")).where("label is not null")


def sample(marks: DataFrame, bound: int) -> DataFrame:
    """(id, start, label, weight): up to ``bound`` labelled findings, the first of each label by hash of id and place.

    A label has bound / 2 places, and those that the other one leaves free; up to ``bound`` findings, all are taken.
    ``weight`` is how many findings of its label one stands for.
    """
    n = {0: 0, 1: 0} | {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    parts = []
    for label in (0, 1):
        most = max(bound // 2, bound - n[1 - label])
        parts.append(marks.where(F.col("label") == label).orderBy(F.xxhash64("id", "start"), "id", "start").limit(most)
                     .withColumn("weight", F.lit(max(n[label] / most, 1.0))))
    return parts[0].union(parts[1])


def scan(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         threshold: float = 0.5, bound: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 7) -> DataFrame:
    """Every candidate of every whole text, judged: id, start, candidate, score, is_secret, known_form.

    ``labels`` (id, start, label 0 or 1) has labelled findings; without, ``seed_labels``. The forest learns from
    at most ``bound`` of them, bound / 2 of each label or more where the other has fewer (see ``sample``), weighted
    to the true counts of the labels. ``score`` is the forest's and ``is_secret`` is score >= ``threshold``, for findings of a
    known form too; ``known_form`` tells these. Without labelled secrets there is nothing to learn: every score
    is 0, and with reviewed labels findings of a known form are secrets unless they are labelled none themselves.
    With labelled secrets only, every score is 1.

    Null and empty texts have no candidates. Rows of null id are scanned, and never labelled. Repeated rows
    give repeated findings. An empty table gives no rows. Other columns are ignored.
    """
    found = stored(candidates(docs, id_col, text_col, path_col).withColumn("key", F.monotonically_increasing_id()), "candidates")
    marks = seed_labels(found) if labels is None else labels.select("id", "start", "label").join(found.select("id", "start"), ["id", "start"], "left_semi")
    marks = stored(marks.where("id is not null and label is not null").groupBy("id", "start").agg(F.max("label").cast("int").alias("label")), "marks")
    labelled = stored(found.dropDuplicates(["id", "start"]).join(F.broadcast(stored(sample(marks, bound), "sample")), ["id", "start"]), "labelled")
    table = stored(features(found, labelled, dictionary(docs, text_col)), "features")
    got = labelled.agg(F.avg("label").alias("p")).first().p or 0.0
    if got in (0.0, 1.0):
        judged = table.withColumn("score", F.lit(got))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = vectors.transform(table.join(F.broadcast(labelled.select("key", "label", "weight")), "key").orderBy("id", "start"))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", weightCol="weight").fit(train.select("features", "label", "weight"))
        judged = forest.transform(vectors.transform(table)).withColumn("score", vector_to_array("probability")[1])
    judged = judged.withColumns({"is_secret": F.col("score") >= threshold, "known_form": known_form()})
    if labels is not None and not got:
        none = marks.select(F.col("id").alias("_id"), F.col("start").alias("_start"), F.lit(True).alias("_none"))
        judged = (judged.join(none, (F.col("id") == F.col("_id")) & (F.col("start") == F.col("_start")), "left")
                  .withColumn("is_secret", F.col("is_secret") | (F.col("known_form") & F.col("_none").isNull())))
    return judged.select(F.col("id").alias(id_col), "start", "candidate", "score", "is_secret", "known_form")
