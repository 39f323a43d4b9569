"""Features of tokens and characters in context, by lag and lead over document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.tokens import KEY, cut, in_order

OFFSETS = (-2, -1, 1, 2)


def shifted(column: Column | str, offset: int, w: WindowSpec | None = None, default: str | None = None) -> Column:
    w = w or in_order()
    return F.lead(column, offset, default).over(w) if offset > 0 else F.lag(column, -offset, default).over(w)


def token_context(tokens: DataFrame, text: str = "text", offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """Own features, those of neighbours under ``-1:`` and so on (null beyond the ends), and flags where an end is reached."""
    own = T.token_features(text)
    out = {k: v for k, v in own.items()}
    place, size = F.row_number().over(in_order()), F.count("*").over(Window.partitionBy("doc_id"))
    for n in offsets:
        for k, v in own.items():
            out[f"{n:+d}:{k}"] = shifted(v, n)
    for n in {abs(n) for n in offsets}:
        out[f"BOD[-{n}]"] = place <= n
        out[f"EOD[+{n}]"] = size - place < n
    return tokens.withColumns(out)


def text_context(texts: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """``token_context`` of the tokens of texts, each a document of its own: neighbours stand at one place of shifted arrays."""
    reach = max(abs(n) for n in offsets)
    beyond = F.array_repeat(F.lit(None).cast("string"), reach)
    shifted_by = {n: F.slice(F.concat(beyond, F.col("_token.text"), beyond), 1 + reach + n, F.size("_token")).alias(f"_{n + reach}") for n in offsets}
    beside = texts.select("doc_id", cut().alias("_token")).select("doc_id", "_token", *shifted_by.values())
    zipped = F.arrays_zip("_token", *[f"_{n + reach}" for n in offsets])
    rows = beside.select("doc_id", F.size("_token").alias("_size"), F.posexplode_outer(zipped).alias("_place", "_at"))
    out = {k: v for k, v in T.token_features(F.col("_at._token.text")).items()}
    for n in offsets:
        near = F.col(f"_at._{n + reach}")
        out |= {f"{n:+d}:{k}": F.when(near.isNotNull(), v) for k, v in T.token_features(near).items()}
    for n in {abs(n) for n in offsets}:
        out[f"BOD[-{n}]"] = F.col("_place") < n
        out[f"EOD[+{n}]"] = F.col("_size") - F.col("_place") - 1 < n
    return rows.select("doc_id", *[F.col(f"_at._token.{c}").alias(c) for c in (*KEY[1:], "text")], *[v.alias(k) for k, v in out.items()])


def char_context(texts: DataFrame, text: str = "text", reach: int = 3) -> DataFrame:
    """A row per character with its features and its neighbours', '' beyond the ends, up to ``reach`` to either side."""
    chars = texts.select("doc_id", F.posexplode(F.split(text, "(?s)(?<=.)(?=.)")).alias("char_idx", "ch")).where("ch <> ''")
    w = Window.partitionBy("doc_id").orderBy("char_idx")
    out = {f"ch.{k}": v for k, v in T.char_features("ch").items()}
    for n in [k for k in range(-reach, reach + 1) if k]:
        out[f"{n:+d}:ch"] = shifted(F.lower("ch"), n, w, "")
    return chars.withColumns(out)


def feature_map(row_features: dict[str, Column]) -> Column:
    """Features as a sparse map of strings: absent neighbours have no key."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in row_features.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
