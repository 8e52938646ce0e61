"""Text-pair loaders for simplification corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.splits import ensure_splits, three_way_split, union_splits

# Per-corpus column names mapped onto (complex, simple).
RENAMES = {"wikilarge": {"Normal": "complex", "Simple": "simple"},
           "multisim": {"original": "complex"}}


def rename_pairs(df: DataFrame, kind: str) -> DataFrame:
    """Corpus-specific names -> ``complex`` / ``simple``."""
    ren = {k: v for k, v in RENAMES.get(kind, {}).items() if k in df.columns}
    return df.withColumnsRenamed(ren) if ren else df


def first_reference(df: DataFrame, refs: str = "simplifications", original: str = "original") -> DataFrame:
    """Drop rows whose reference list is empty; take its first element."""
    return (df.where(F.size(refs) > 0)
            .withColumn("simple", F.get(F.col(refs), 0)).withColumnRenamed(original, "complex").drop(refs))


def drop_incomplete_pairs(df: DataFrame, cols=("complex", "simple")) -> DataFrame:
    """P10: keep rows that have both fields."""
    return df.dropna(subset=list(cols))


def require_pair_columns(df: DataFrame, cols=("complex", "simple")) -> None:
    """U4: the required columns must be a subset of the table's columns."""
    if not set(cols) <= set(df.columns):
        raise ValueError(f"columns {sorted(set(cols) - set(df.columns))} missing from {df.columns}")


def load_pairs(df: DataFrame, kind: str, id_col: str, seed=42, split_col: str = "split") -> DataFrame:
    """C11: turk -> first reference -> union -> seeded 80/10/10; wikilarge and
    multisim -> keep or re-split (L6) -> rename -> drop incomplete rows."""
    if kind == "turk":
        flat = first_reference(df.drop(split_col) if split_col in df.columns else df)
        return three_way_split(union_splits([flat]), id_col, seed, split_col)
    d = df if split_col in df.columns else df.withColumn(split_col, F.lit(None).cast("string"))
    out = drop_incomplete_pairs(rename_pairs(ensure_splits(d, id_col, seed, split_col), kind))
    require_pair_columns(out)
    return out


def load_csv_pairs(spark, path: str, ratios: dict[str, float] | None = None, seed=42, split_col: str = "split", multi_line: bool = True) -> DataFrame:
    """C11, local file: CSV or TSV pairs -> seeded splits by the given ratios.  Rows have no id,
    so the hash is that of the pair itself and equal pairs share a split."""
    from corpuskit.operators.splits import hash_split
    from corpuskit.sources.io import read_pairs_csv
    pairs = drop_incomplete_pairs(read_pairs_csv(spark, path, multi_line=multi_line))
    keyed = pairs.withColumn("_key", F.md5(F.concat_ws("|", "complex", "simple")))
    return hash_split(keyed, "_key", ratios or {"train": 0.8, "validation": 0.1, "test": 0.1}, seed, split_col).drop("_key")
