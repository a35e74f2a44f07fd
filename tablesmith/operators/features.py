"""Feature transformers.

Fit steps are one aggregate whose small result (bin edges, vocabulary,
moments, category lists) becomes literals of one projection; Spark ML stages
are used where they are the built-in form (Bucketizer, StringIndexer,
OneHotEncoder, VectorAssembler, scalers, PCA, VectorIndexer).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (PCA, Bucketizer, Imputer, MinMaxScaler, OneHotEncoder, StandardScaler,
                                StringIndexer, VectorAssembler, VectorIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import columns as C
from tablesmith.functions import text as TX
from tablesmith.functions.columns import nan_free, quoted
from tablesmith.plans import quantiles as Q

#: The widest one-column-per-category output by default; wider ones raise an error.
MAX_WIDE_COLUMNS = 1000


# ---------------------------------------------------------------- E1-E3

def bucketize(df: DataFrame, c: str, splits: Sequence[float], out: str,
              handle_invalid: str = "keep") -> DataFrame:
    """Spark's Bucketizer, [a, b) buckets, last one closed."""
    return Bucketizer(splits=list(splits), inputCol=c, outputCol=out, handleInvalid=handle_invalid).transform(df)


def cut_labels(df: DataFrame, c: str, edges: Sequence[float], labels: Sequence[str] | None, out: str,
               closed: str = "right", include_lowest: bool = False) -> DataFrame:
    """Pd.cut-like named bins (D9); outside or missing -> null."""
    return df.withColumn(out, C.cut(c, edges, labels, closed, include_lowest))


def quantile_edges(df: DataFrame, c: str, q: int, exact: bool = True) -> list[float]:
    """Edges at i/q (i = 0..q), duplicates dropped (as pd.qcut(duplicates='drop'))."""
    probs = [i / q for i in range(q + 1)]
    vals = Q.quantiles(df, [c], probs, exact=exact)[c]
    edges: list[float] = []
    for v in vals:
        if v is not None and (not edges or v > edges[-1]):
            edges.append(float(v))
    return edges


def quantile_bins(df: DataFrame, c: str, q: int, out: str, labels: Sequence[str] | None = None,
                  exact: bool = True) -> DataFrame:
    """Q equal-frequency bins, right-closed with the minimum included."""
    edges = quantile_edges(df, c, q, exact)
    if len(edges) < 2:
        return df.withColumn(out, F.when(F.col(c).isNotNull(), F.lit(0)))
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError("labels must match the number of bins left after dropping duplicate edges")
    return df.withColumn(out, C.cut(c, edges, labels, closed="right", include_lowest=True))


def quantile_discretize(df: DataFrame, c: str, q: int, out: str, relative_error: float = 0.001) -> DataFrame:
    """E3, scale variant: Spark's QuantileDiscretizer (sketch edges, [a, b) buckets)."""
    from pyspark.ml.feature import QuantileDiscretizer
    return QuantileDiscretizer(numBuckets=q, inputCol=c, outputCol=out, relativeError=relative_error,
                               handleInvalid="keep").fit(df).transform(df)


# ---------------------------------------------------------------- E4-E5

def date_features(df: DataFrame, c: str, as_of: str, prefix: str = "") -> DataFrame:
    """Year, month, weekday (1 = Sunday), weekend flag, days since, season.

    ``as_of`` is a fixed date (never current_date) so results are repeatable.
    """
    d = F.to_date(F.col(c))
    p = prefix or f"{c}_"
    return df.withColumns({
        f"{p}year": F.year(d), f"{p}month": F.month(d), f"{p}dayofweek": F.dayofweek(d),
        f"{p}is_weekend": C.is_weekend(d),
        f"{p}days_since": F.datediff(F.to_date(F.lit(as_of)), d),
        f"{p}season": C.season(F.month(d)),
    })


def synthetic_date(df: DataFrame, key: Sequence[str], out: str, as_of: str, days: int = 1825,
                   salt: str = "") -> DataFrame:
    """E5: a date within ``days`` before ``as_of``, drawn from a hash of the key
    (repeatable and independent of partitioning)."""
    offset = F.pmod(C.hash_unit(key, salt), F.lit(days)).cast("int")
    return df.withColumn(out, F.date_sub(F.to_date(F.lit(as_of)), offset))


# ---------------------------------------------------------------- E6-E8

def tokenize(df: DataFrame, c: str, out: str = "words") -> DataFrame:
    """Lower-case, split on whitespace runs (no empty tokens)."""
    return df.withColumn(out, TX.whitespace_tokens(c))


@dataclass
class Vocabulary:
    terms: list[str]


def fit_vocabulary(tokens: DataFrame, col: str, vocab_size: int, min_df: int = 1, without: Sequence[str] = ()) -> Vocabulary:
    """Top terms by corpus count (ties: term ascending) among terms in >= min_df documents, none of ``without``.

    One pass without a shuffle of documents: every token brings one to its term's count and every distinct
    token of a document one to its document frequency; both are summed with a map-side combine.  Only
    the chosen ``vocab_size`` terms reach the driver.
    """
    words = F.col(col)
    if min_df > 1:
        both = tokens.select(F.posexplode(F.array(words, F.array_distinct(words))).alias("part", "terms"))  # 0: all, 1: distinct
        g = both.select("part", F.explode("terms").alias("term")).groupBy("term").agg(
            F.count_if(F.col("part") == 0).alias("n"), F.count_if(F.col("part") == 1).alias("df"))
        g = g.where(F.col("df") >= min_df)
    else:
        g = tokens.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if without:  # from the term table, not from every document
        g = g.where(~F.col("term").isin(*without))
    top = g.orderBy(F.col("n").desc(), F.col("term").asc()).limit(vocab_size).collect()
    return Vocabulary([r["term"] for r in top])


def _counts(words: Column, vocab: Vocabulary) -> Column:
    """How often each vocabulary term (at most ``vocab_size`` literals) is among the words, in the vocabulary's order.

    The words that count are picked out once; a lambda's variable holds them while the terms are counted.
    """
    terms = F.array(*[F.lit(t) for t in vocab.terms]).cast("array<string>")
    held = F.filter(words, lambda w: w.isin(*vocab.terms))
    each = F.transform(F.array(held), lambda h: F.transform(terms, lambda t: F.size(F.filter(h, lambda w: w == t))))
    return F.get(each, F.lit(0))


def term_counts(tokens: DataFrame, id_col: str, col: str, vocab: Vocabulary) -> DataFrame:
    """Long counts (id, term_index, term, n) of vocabulary terms per document, counted inside the row."""
    terms = F.array(*[F.lit(t) for t in vocab.terms]).cast("array<string>")
    found = tokens.select(quoted(id_col), F.posexplode(_counts(F.col(col), vocab)).alias("term_index", "n")).where(F.col("n") > 0)
    return found.select(quoted(id_col), "term_index", F.get(terms, F.col("term_index")).alias("term"), F.col("n").cast("long").alias("n"))


def count_vectorize(df: DataFrame, id_col: str, text_col: str, vocab_size: int = 30, min_df: int = 1):
    """Tokenize, choose the vocabulary, count.  Returns (counts, vocabulary).

    Two passes over the texts and no shuffle of documents: the first sums terms with a map-side combine,
    the second keeps the chosen terms' tokens and counts them in the row.
    """
    toks = tokenize(df.select(quoted(id_col), quoted(text_col)), text_col, "words")
    vocab = fit_vocabulary(toks, "words", vocab_size, min_df)
    return term_counts(toks, id_col, "words", vocab), vocab


def count_vectorize_wide(df: DataFrame, id_col: str, text_col: str, max_features: int = 30, min_df: int = 5,
                         prefix: str = "cv_") -> DataFrame:
    """Word tokens (2+ word chars), English stop words removed, vocabulary of
    terms in >= min_df documents by corpus count, one count column per term, counted in the row."""
    words = df.select(quoted(id_col), TX.word_tokens(text_col).alias("words"))
    vocab = fit_vocabulary(words, "words", max_features, min_df, TX.ENGLISH_STOP_WORDS)
    each = words.select(quoted(id_col), _counts(F.col("words"), vocab).alias("_counts"))
    return each.select(quoted(id_col), *[F.coalesce(F.get("_counts", F.lit(i)), F.lit(0)).cast("long").alias(f"{prefix}{t}")
                                         for i, t in enumerate(vocab.terms)])


# ---------------------------------------------------------------- E9-E12

def string_index(df: DataFrame, c: str, out: str, order: str = "frequencyDesc",
                 handle_invalid: str = "error") -> tuple[DataFrame, object]:
    """Spark StringIndexer (frequency order, ties alphabetical; or alphabetAsc)."""
    m = StringIndexer(inputCol=c, outputCol=out, stringOrderType=order, handleInvalid=handle_invalid).fit(df)
    return m.transform(df), m


def one_hot_vector(df: DataFrame, index_col: str, out: str, drop_last: bool = True,
                   as_array: bool = True, handle_invalid: str = "error") -> DataFrame:
    """Index -> 0/1 vector, last slot dropped (Spark semantics, D12).

    With ``handle_invalid="keep"`` Spark adds an unknown slot at the end, so every
    real category keeps a slot and the dropped one is the unknown slot.
    """
    m = OneHotEncoder(inputCols=[index_col], outputCols=[out], dropLast=drop_last,
                      handleInvalid=handle_invalid).fit(df)
    res = m.transform(df)
    return res.withColumn(out, vector_to_array(out)) if as_array else res


def one_hot_wide(df: DataFrame, c: str, prefix: str | None = None, drop_first: bool = True,
                 categories: Sequence[str] | None = None, max_columns: int = MAX_WIDE_COLUMNS) -> DataFrame:
    """One 0/1 int column per category (sorted), first dropped; missing or
    unseen -> all zeros.  More than ``max_columns`` categories raise an error."""
    prefix = prefix if prefix is not None else c
    if categories is None:
        cats = (df.select(c).where(F.col(c).isNotNull()).distinct()
                .limit(max_columns + 1).collect())
        if len(cats) > max_columns:
            raise ValueError(f"{c} has more than {max_columns} categories; use one_hot_vector")
        categories = sorted(r[0] for r in cats)
    cats = list(categories)[1:] if drop_first else list(categories)
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
                           for v in cats})


def assemble_vector(df: DataFrame, cols: Sequence[str], out: str = "features",
                    handle_invalid: str = "skip") -> DataFrame:
    """Columns / vectors -> one vector; rows with missing skipped by default."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)


# ---------------------------------------------------------------- E13-E16

def scale_standard_wide(df: DataFrame, cols: Sequence[str], ddof: int = 1, with_mean: bool = True,
                        suffix: str = "_std") -> DataFrame:
    """(x - mean) / sd as new columns; sd with n - ddof (D7); sd 0 -> 0."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    df = nan_free(df, cols)
    row = df.agg(*[e for i, c in enumerate(cols)
                   for e in (F.avg(quoted(c)).alias(f"m{i}"), sd(quoted(c)).alias(f"s{i}"))]).collect()[0]
    new = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        centred = F.col(quoted(c)) - F.lit(m) if with_mean else F.col(quoted(c))
        new[c + suffix] = F.lit(0.0) if not s else centred / F.lit(s)
    return df.withColumns(new)


def scale_minmax_wide(df: DataFrame, cols: Sequence[str], suffix: str = "_minmax") -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0.5 (Spark rule)."""
    df = nan_free(df, cols)
    row = df.agg(*[e for i, c in enumerate(cols)
                   for e in (F.min(quoted(c)).alias(f"lo{i}"), F.max(quoted(c)).alias(f"hi{i}"))]).collect()[0]
    new = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        new[c + suffix] = F.lit(0.5) if hi == lo else (F.col(quoted(c)) - F.lit(lo)) / F.lit(float(hi - lo))
    return df.withColumns(new)


def scale_vector(df: DataFrame, vec: str, out: str, kind: str = "standard", with_mean: bool = True):
    """E13/E14 on a vector column with Spark's scalers; returns (frame, model)."""
    est = (StandardScaler(inputCol=vec, outputCol=out, withMean=with_mean, withStd=True) if kind == "standard"
           else MinMaxScaler(inputCol=vec, outputCol=out))
    m = est.fit(df)
    return m.transform(df), m


def vector_to_columns(df: DataFrame, vec: str, names: Sequence[str]) -> DataFrame:
    """Vector -> array -> one double column per slot."""
    arr = vector_to_array(vec)
    return df.withColumn("_arr", arr).withColumns(
        {n: F.col("_arr").getItem(i) for i, n in enumerate(names)}).drop("_arr")


def vector_size(df: DataFrame, vec: str, out: str = "n_features") -> DataFrame:
    """E16."""
    return df.withColumn(out, F.size(vector_to_array(vec)))


# ---------------------------------------------------------------- E17-E19

def pca(df: DataFrame, vec: str, k: int, out: str = "pca"):
    """Principal components; each component's sign fixed so that its
    largest-magnitude loading is positive.  Returns (frame, loadings, model)."""
    m = PCA(k=k, inputCol=vec, outputCol=out).fit(df)
    pc = m.pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    res = m.transform(df).withColumn(out, vector_to_array(out))
    res = res.withColumn(out, F.array(*[F.col(out)[j] * F.lit(signs[j]) for j in range(k)]))
    loadings = [[float(pc[i, j] * signs[j]) for j in range(k)] for i in range(pc.shape[0])]
    return res, loadings, m


def pca_variance(model, threshold: float = 0.9, spark=None) -> DataFrame:
    """Explained and cumulative variance per component, and the least k
    reaching ``threshold``."""
    ev = [float(v) for v in model.explainedVariance.toArray()]
    cum, rows, reached = 0.0, [], None
    for i, v in enumerate(ev):
        cum += v
        if reached is None and cum >= threshold:
            reached = i + 1
        rows.append((i + 1, v, cum))
    spark = spark or __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    return spark.createDataFrame([(c, v, s, reached) for c, v, s in rows],
                                 "component int, explained double, cumulative double, k_for_threshold int")


def vector_index(df: DataFrame, vec: str, out: str, max_categories: int = 25):
    """Slots with <= max_categories distinct values become categorical."""
    m = VectorIndexer(inputCol=vec, outputCol=out, maxCategories=max_categories, handleInvalid="skip").fit(df)
    return m.transform(df), m


# ---------------------------------------------------------------- E20-E21

def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], impute: Sequence[str] = (),
                     impute_strategy: str = "median", derived: Mapping[str, tuple[str, str]] | None = None,
                     out: str = "features", scale: bool = True) -> Pipeline:
    """Impute -> derive -> index -> one-hot -> assemble -> scale -> assemble.

    Ratios listed in ``derived`` are computed after imputation (the reference
    used an imputed column before creating it) with SQL ``try_divide``.
    """
    from pyspark.ml.feature import SQLTransformer
    stages = []
    imputed = {c: f"{c}_imputed" for c in impute}
    if impute:
        stages.append(Imputer(inputCols=list(impute), outputCols=[imputed[c] for c in impute],
                              strategy=impute_strategy))
    num = [imputed.get(c, c) for c in numeric]
    if derived:
        exprs = ", ".join(f"try_divide({quoted(imputed.get(a, a))}, {quoted(imputed.get(b, b))}) AS {quoted(n)}"
                          for n, (a, b) in derived.items())
        stages.append(SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"))
        num += list(derived)
    idx = [f"{c}_index" for c in categorical]
    ohe = [f"{c}_ohe" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=num, outputCol="_num", handleInvalid="skip"))
    num_vec = "_num"
    if scale:
        stages.append(StandardScaler(inputCol="_num", outputCol="_num_scaled", withMean=True, withStd=True))
        num_vec = "_num_scaled"
    stages.append(VectorAssembler(inputCols=[num_vec] + ohe, outputCol=out, handleInvalid="skip"))
    return Pipeline(stages=stages)


def feature_names(df: DataFrame, vec: str) -> list[str]:
    """Slot names of an assembled vector, read from ML column metadata."""
    meta = df.schema[vec].metadata.get("ml_attr", {})
    names: dict[int, str] = {}
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a.get("name", f"f{a['idx']}")
    n = meta.get("num_attrs", len(names))
    return [names.get(i, f"f{i}") for i in range(n)]


def column_transformer(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                       out: str = "features") -> tuple[DataFrame, PipelineModel, list[str]]:
    """Scale numeric + one-hot categorical; returns the named feature list."""
    m = feature_pipeline(numeric, categorical, out=out).fit(df)
    res = m.transform(df)
    names = []
    for n in feature_names(res, out):
        if n.startswith("_num_scaled_") or n.startswith("_num_"):
            names.append(list(numeric)[int(n.rsplit("_", 1)[1])])   # scaled slot i = numeric input i
        else:
            names.append(n.replace("_ohe_", "_", 1))                   # c_ohe_value -> c_value
    return res, m, names
