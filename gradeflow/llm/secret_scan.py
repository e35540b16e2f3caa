"""Secret scan with a random forest against false positives (operator 7, native).

Candidates come from one pattern: provider formats, key blocks, assignments to
secret-like names, and long runs of mixed letters and digits.  ``split`` and
``regexp_extract_all`` with the same pattern give each candidate its
neighbourhood without leaving the row.  A random forest (Spark ML) learns from
labelled findings; its trees are turned into CASE expressions, so scoring is
part of the same projection: no Python worker, no explode, no shuffle of texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import write_scratch

LABELLED_ROWS = 20_000   # labelled findings of a label the forest is fitted on, at most
TREES, DEPTH, SEED = 15, 6, 11
CONTEXT = 48             # characters of neighbourhood on each side
MASK = "[SECRET]"

# Formats and names that mark secrets, and common short words.
PROVIDER = (r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+"
            r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
            r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?")
NAMES = "password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential"
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|your[_-]|xxxx|redacted|\\$\\{|<[a-z]"
COMMON = ("the and for with that this from are was not you all can has have one our out page item user name test "
          "data file code http www com org net html index version release build image les des est que pour dans "
          "une sur par der die das und ist von mit den ein nicht los las del por con para ing ion ent ver sch ung").split()
ASSIGNED = rf"(?i:{NAMES})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?[^\s\"']{{6,}}+"
_RUN = r"[A-Za-z0-9_/+\-]"
MIXED = rf"(?<!{_RUN})(?=[A-Za-z_/+\-]*+[0-9])(?=[0-9_/+\-]*+[A-Za-z]){_RUN}{{20,}}+"
CANDIDATE = f"(?:{PROVIDER}|{ASSIGNED}|{MIXED})"
VALUE = r"^(?:(?i:" + NAMES + r")[\"']?\s{0,3}[=:]\s{0,3}[\"']?)?"

FEATURES = ("length", "transitions", "digits", "upper", "variety", "dictionary", "syllables", "named",
            "placeholder", "path_like", "test_path", "provider", "hex")
FINDING = "struct<found:string,value:string,before:string,after:string>"


def findings(text: Column, parts: Column) -> Column:
    """array<FINDING> of the candidates in a text; null parts mean none."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return F.transform(found, lambda c, i: F.struct(
        c.alias("found"), F.regexp_replace(c, VALUE, "").alias("value"),
        F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"),
        F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after")))


def _share(n: Column, value: Column) -> Column:
    return n.cast("double") / F.greatest(F.length(value), F.lit(1))


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def features(c: Column, path: Column) -> Column:
    """array<double> in the order of FEATURES for one finding."""
    v, low = c["value"], F.lower(c["value"])
    near = F.concat_ws(" ", F.lower(c["before"]), F.lower(c["found"]))
    return F.array(
        F.length(v).cast("double"),
        _share(_count(v, r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"), v),
        _share(_count(v, "[0-9]"), v), _share(_count(v, "[A-Z]"), v),
        _share(F.size(F.array_distinct(F.split(v, ""))), v),
        _share(F.length(v) - F.length(F.regexp_replace(low, "|".join(COMMON), "")), v),
        _share(_count(low, "[bcdfghjklmnpqrstvwxz][aeiou]"), v),
        near.rlike(rf"(?:{NAMES})\W{{0,8}}").cast("double"),
        F.concat_ws(" ", near, F.lower(c["after"])).rlike(PLACEHOLDER).cast("double"),
        (_count(v, "[/_-]") >= 2).cast("double"),
        F.coalesce(F.lower(path), F.lit("")).rlike("test|spec|example|doc|fixture").cast("double"),
        c["found"].rlike(f"^(?:{PROVIDER})$").cast("double"),
        v.rlike("^[0-9a-fA-F]{16,}$").cast("double"))


def _with_parts(df: DataFrame, text: str) -> DataFrame:
    """Adds __parts (the text between candidates, null without one) and
    __cands.  Names are reserved; columns of the input that carry them are the
    caller's to rename."""
    t = F.col(f"`{text}`")
    df = df.withColumn("__parts", F.when(t.rlike(CANDIDATE), F.split(t, CANDIDATE, -1)))
    none = F.array().cast(f"array<{FINDING}>")
    return df.withColumn("__cands", F.when(F.col("__parts").isNull(), none).otherwise(findings(t, F.col("__parts"))))


# -- learning ------------------------------------------------------------------
def labelled_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(finding, path, label): findings whose nature their form settles.

    Label 1: provider formats, and secret-like names assigned a value of mixed
    letters and digits.  Label 0: placeholders, values of words, and decoys made
    from the corpus itself - slugs and versioned names of its words - which a
    scanner of mixed runs would report.  Bounded: of each label the
    LABELLED_ROWS / 2 smallest by hash, equal findings of a path as one row;
    decoys come from one text in a bounded set each."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"),
                       (F.col(path) if path in docs.columns else F.lit("")).cast("string").alias("p"))
    found = _with_parts(rows, "t").select(F.explode("__cands").alias("c"), "p")
    v = F.col("c.value")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    label = (F.when(F.concat_ws(" ", F.lower("c.before"), F.lower("c.found"), F.lower("c.after")).rlike(PLACEHOLDER), 0)
             .when(F.col("c.found").rlike(f"^(?:{PROVIDER})$"), 1)
             .when(F.col("c.found").rlike(f"^(?i:{NAMES})") & mixed, 1)
             .when(F.col("c.found").rlike(f"^(?i:{NAMES})") & ~v.rlike("[0-9]"), 0))
    # copies and shared boilerplate give one row, or they would fill the sample
    known = (found.withColumn("label", label).where("label is not null").groupBy("c", "p")
             .agg(F.min("label").alias("label")).withColumn("o", F.xxhash64("c", "p")))
    # the texts with the smallest hashes: their bound first, then their words
    hashed = rows.where("t is not null").withColumn("o", F.xxhash64("k", "t"))
    last = hashed.select("o").orderBy("o").limit(LABELLED_ROWS // 8).agg(F.max("o")).first()[0]
    w = F.filter(F.split(F.regexp_replace(F.lower("t"), "[^a-z ]", ""), " +"), lambda x: F.length(x) > 2)
    base = (hashed.where(F.col("o") <= F.lit(last).cast("long")).select("p", "o", F.slice(w, 1, 8).alias("w"))
            .where(F.size("w") >= 8).dropDuplicates(["o"]))
    n = F.pmod("o", F.lit(9000)).cast("string")

    def decoy(value: Column, name: Column) -> Column:
        return F.struct(value.alias("found"), F.regexp_replace(value, VALUE, "").alias("value"),
                        name.alias("before"), F.element_at("w", 8).alias("after"))

    slug = F.concat_ws("-", F.slice("w", 1, 4), n)
    decoys = base.select(F.explode(F.array(
        decoy(slug, F.element_at("w", 5)),
        decoy(F.concat_ws("/", F.lit("page"), F.slice("w", 2, 3), n), F.lit("see ")),
        decoy(F.concat(F.concat_ws("_", F.slice("w", 3, 4)), F.lit("_v"), n), F.element_at("w", 6)),
        decoy(F.concat(F.lit("token="), F.concat_ws("-", F.slice("w", 1, 3))), F.element_at("w", 7)))).alias("c"),
        "p", F.lit(0).alias("label"), "o")
    known = write_scratch(known, "secret-known")
    out = decoys.select("c", "p", "label")
    for y in (0, 1):
        out = out.unionByName(known.where(F.col("label") == y).orderBy("o").limit(LABELLED_ROWS // 2).select("c", "p", "label"))
    return out


def fit(labelled: DataFrame) -> str | None:
    """SQL over ``x`` (feature array) for the share of trees that say secret;
    None when the findings don't hold both labels (then every candidate stays).
    Equal findings of a path and label count once; of each label the
    LABELLED_ROWS smallest by hash are used."""
    data = labelled.dropDuplicates(["c", "p", "label"]).select(
        features(F.col("c"), F.col("p")).alias("x"), F.col("label").cast("double").alias("label"),
        F.xxhash64("c", "p").alias("o"))
    # the findings are gathered once; their order fixes the forest
    data = write_scratch(data, "secret-findings")
    classes = [r[0] for r in data.groupBy("label").count().orderBy("label").collect()]
    if len(classes) < 2:
        return None
    parts = [data.where(F.col("label") == y).orderBy("o", "x").limit(LABELLED_ROWS).select("x", "label") for y in classes]
    data = reduce(DataFrame.unionByName, parts).orderBy("label", "x")
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH,
                                   seed=SEED, featureSubsetStrategy="sqrt").fit(
        data.withColumn("features", array_to_vector("x")))
    return forest_sql(model)


def forest_sql(model) -> str:
    """The forest's vote share as nested CASE expressions over the array ``x``."""
    def node_sql(node) -> str:
        if node.numDescendants() == 0:
            return f"{float(node.prediction())!r}D"
        s = node.split()
        return (f"CASE WHEN get(x, {s.featureIndex()}) <= {s.threshold()!r}D THEN {node_sql(node.leftChild())} "
                f"ELSE {node_sql(node.rightChild())} END")

    trees = [node_sql(t._java_obj.rootNode()) for t in model.trees]
    return "(" + " + ".join(f"({t})" for t in trees) + f") / {float(len(trees))!r}D"


# -- scanning ------------------------------------------------------------------
def scan(df: DataFrame, forest: str | None, text: str = "text", path: str = "source") -> DataFrame:
    """Adds ``secret_findings`` (found, value, before, after, probability,
    is_secret) and ``redacted_text`` to the rows of ``df``.

    A candidate is a secret where at least half of the trees say so.  In the
    redacted text the value of each secret gives way to a mask; names, quotes
    and removed false positives stay.  Null and empty texts have no findings
    and stay as they are; repeated rows give repeated results; columns of
    ``df`` with one of the two names are replaced."""
    df = df.drop("secret_findings", "redacted_text")
    p = F.col(f"`{path}`").cast("string") if path in df.columns else F.lit("")
    out = _with_parts(df, text)
    out = out.withColumn("__x", F.transform("__cands", lambda c: features(c, p)))
    vote = f"transform(__x, x -> {forest})" if forest else "transform(__x, x -> 1.0D)"
    out = out.withColumn("__p", F.expr(vote).cast("array<double>"))
    out = out.withColumn("secret_findings", F.zip_with("__cands", "__p", lambda c, q: F.struct(
        c["found"].alias("found"), c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"),
        q.alias("probability"), (q >= 0.5).alias("is_secret"))))
    shown = F.transform("secret_findings", lambda c, i: F.concat(
        F.get("__parts", i),
        F.when(c["is_secret"], F.concat(F.left(c["found"], F.length(c["found"]) - F.length(c["value"])), F.lit(MASK)))
        .otherwise(c["found"])))
    t = F.col(f"`{text}`")
    out = out.withColumn("redacted_text", F.when(F.col("__parts").isNull(), t).otherwise(
        F.concat(F.array_join(shown, ""), F.element_at("__parts", -1))))
    return out.drop("__parts", "__cands", "__x", "__p")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source",
            labelled: DataFrame | None = None) -> DataFrame:
    """key, n_candidates, n_secrets, findings (value digests, probability), redacted_sha256."""
    forest = fit(labelled if labelled is not None else labelled_findings(docs, key, text, path))
    cols = [c for c in dict.fromkeys([key, text, path]) if c in docs.columns]
    return scan(docs.select(*[f"`{c}`" for c in cols]), forest, text, path).select(
        F.col(key), F.size("secret_findings").cast("long").alias("n_candidates"),
        F.size(F.filter("secret_findings", lambda c: c["is_secret"])).cast("long").alias("n_secrets"),
        F.transform("secret_findings", lambda c: F.struct(
            F.sha2(c["value"], 256).alias("value_sha256"), c["probability"].alias("probability"))).alias("findings"),
        F.sha2(F.coalesce("redacted_text", F.lit("")), 256).alias("redacted_sha256"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source",
           length: str = "n_chars") -> DataFrame:
    """The rows with secrets masked in their text and the length column, where
    there is one, brought up to date; columns and order as they were."""
    forest = fit(labelled_findings(docs, key, text, path))
    kinds = dict(docs.dtypes)
    fresh = {text: F.col("redacted_text")}
    if length in kinds:
        fresh[length] = F.length("redacted_text").cast(kinds[length])
    reserved = {"secret_findings", "redacted_text", "__parts", "__cands", "__x", "__p"}
    clash = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in reserved}
    renamed = docs.withColumnsRenamed(clash)
    out = scan(renamed, forest, text, path)
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def candidates_of(text: str) -> list[str]:
    """The pattern's matches in one text, for tests (same syntax in Python 3.11 on)."""
    return [m.group() for m in re.finditer(CANDIDATE, text)]
