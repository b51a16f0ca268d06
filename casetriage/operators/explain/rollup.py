"""Roll-ups of per-slot contributions.

All operate inside the row on the ``phi`` array with slot lists taken from
the fitted feature names (bounded), so a batch of any size is explained by
narrow projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.scalar import const_array
from ..ranking import sort_abs_desc


def slot_sum(phi: Column, slots: list[int], n_slots: int | None = None) -> Column:
    """Sum of phi over the given 0-based slots (0.0 for none), in slot order.

    ``phi`` is only ever consumed whole (slice / zip with a mask literal):
    indexing it inside a lambda would let the optimizer inline the phi
    expression into the lambda and recompute it once per element."""
    if not slots:
        return F.lit(0.0)
    s = sorted(slots)
    if s == list(range(s[0], s[-1] + 1)):
        part = F.slice(phi, s[0] + 1, len(s))
        return F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
    n = n_slots if n_slots is not None else s[-1] + 1
    keep = set(s)
    mask = const_array([j in keep for j in range(n)])
    return F.aggregate(F.zip_with(phi, mask, lambda p, m: F.when(m, p)), F.lit(0.0),
                       lambda a, v: F.when(v.isNull(), a).otherwise(a + v))


def tabular_contribs(phi: Column, names: list[dict], sources: list[str],
                     values: dict[str, Column]) -> Column:
    """One struct(feature, value, contribution) per source column
    (one-hot slots summed), ordered by |contribution| descending."""
    items = []
    for src in sources:
        slots = [n["idx"] for n in names if n["source_col"] == src]
        items.append(F.struct(F.lit(src).alias("feature"),
                              values[src].cast("string").alias("value"),
                              slot_sum(phi, slots).alias("contribution")))
    return sort_abs_desc(F.array(*items))


def top_tokens(phi: Column, names: list[dict], k: int = 10, min_abs: float = 0.001) -> Column:
    """I7 tokens: the k text slots with the largest |phi|, then those above
    ``min_abs`` (the cut is applied after taking k, as in the reference)."""
    text = [n["idx"] for n in names if n["block"] == "text"]
    if not text:
        return F.array().cast("array<struct<token:string,contribution:double>>")
    assert text == list(range(text[0], text[-1] + 1)), "text slots must be contiguous"
    pairs = F.zip_with(const_array([n["name"] for n in names]), phi,
                       lambda nm, p: F.struct(nm.alias("token"), p.alias("contribution")))
    toks = F.slice(pairs, text[0] + 1, len(text))
    top = F.slice(sort_abs_desc(toks), 1, k)
    return F.filter(top, lambda t: F.abs(t["contribution"]) > min_abs)


def group_slots(names: list[dict], token_group_rows: list[tuple[str, str]],
                groups: list[str]) -> dict[str, list[int]]:
    """Slots of every group from (token, group) pairs (H2 output)."""
    idx = {n["name"]: n["idx"] for n in names if n["block"] == "text"}
    out = {g: [] for g in groups}
    for tok, g in token_group_rows:
        if tok in idx and g in out:
            out[g].append(idx[tok])
    return {g: sorted(set(v)) for g, v in out.items()}


def semantic_groups(phi: Column, slots: dict[str, list[int]], n_slots: int | None = None) -> Column:
    """I7 groups: map group -> summed phi (0.0 for a group with no tokens)."""
    return F.map_from_arrays(F.array(*[F.lit(g) for g in slots]),
                             F.array(*[slot_sum(phi, s, n_slots) for s in slots.values()]))


def uncategorized(phi: Column, names: list[dict], slots: dict[str, list[int]]) -> Column:
    used = {i for s in slots.values() for i in s}
    return slot_sum(phi, [n["idx"] for n in names if n["block"] == "text" and n["idx"] not in used],
                    len(names))


def dominant_theme(groups_map: Column) -> Column:
    """H3: struct(theme, value) of the largest strictly positive group
    (first in declared order on ties); (null, 0.0) when none is positive."""
    init = F.struct(F.lit(None).cast("string").alias("theme"), F.lit(0.0).alias("value"))
    return F.aggregate(F.map_entries(groups_map), init,
                       lambda acc, e: F.when(e["value"] > acc["value"],
                                             F.struct(e["key"].alias("theme"), e["value"].alias("value")))
                       .otherwise(acc))


def top_features(phi: Column, names: list[dict], k: int = 10) -> Column:
    """The k feature slots with the largest |phi|."""
    all_ = F.zip_with(const_array([n["name"] for n in names]), phi,
                      lambda nm, p: F.struct(nm.alias("feature"), p.alias("contribution")))
    return F.slice(sort_abs_desc(all_), 1, k)


def contribs_long(df: DataFrame, key: str, arr: str) -> DataFrame:
    """Array of structs -> rows with 1-based rank."""
    from ..reshape import explode_array
    return explode_array(df, [key], arr, "c", "pos").select(
        key, (F.col("pos") + 1).alias("rank"), "c.*")
