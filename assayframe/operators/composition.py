"""Compositions: from formula strings to a long (row, element, amount) table.

The long table holds one row per (row_id, element); every other composition
operator takes it as input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# An element with its amount, an opening bracket, or a closing bracket with its multiplier.
_TOKEN = r"([A-Z][a-z]?[0-9.]*|\(|\)[0-9.]*)"
_NUMBER = r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"


def _amount(text: Column) -> Column:
    """Missing number means one; a malformed one gives NULL."""
    return F.when(text == "", F.lit(1.0)).when(text.rlike(_NUMBER), text.try_cast("double"))


def _bound(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, however often that mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _element(tok: Column, times: Column | None = None) -> Column:
    """struct<element, amount> of an element token; the amount is NULL when malformed."""
    num = _amount(F.regexp_extract(tok, r"[0-9.]*$", 0))
    return F.struct(F.regexp_extract(tok, r"^[A-Z][a-z]?", 0).alias("element"), (num if times is None else num * times).alias("amount"))


_PARTS = "array<struct<element:string,amount:double>>"


def _flat_parts(tokens: Column) -> Column:
    """Elements of a formula without brackets."""
    return _bound(F.transform(tokens, lambda t: _element(t)), lambda p: F.when(F.forall(p, lambda e: e["amount"].isNotNull()), p))


def _nested_parts(tokens: Column) -> Column:
    """Elements of a formula with brackets, nested to any depth: tokens are folded from
    the right with a stack of bracket multipliers."""
    start = F.struct(
        F.array(F.lit(1.0)).alias("stack"), F.array().cast(_PARTS).alias("parts"), F.lit(True).alias("ok")
    )

    def step(acc: Column, tok: Column) -> Column:
        stack, parts, ok = acc["stack"], acc["parts"], acc["ok"]
        top, depth = F.element_at(stack, -1), F.size(stack)
        times = _amount(F.regexp_extract(tok, r"[0-9.]*$", 0))
        close = F.struct(
            F.concat(stack, F.array(top * F.coalesce(times, F.lit(1.0)))).alias("stack"), parts.alias("parts"),
            (ok & times.isNotNull()).alias("ok"),
        )
        open_ = F.struct(
            F.when(depth > 1, F.slice(stack, F.lit(1), depth - 1)).otherwise(stack).alias("stack"), parts.alias("parts"),
            (ok & (depth > 1)).alias("ok"),
        )
        plain = F.struct(
            stack.alias("stack"), F.concat(parts, F.array(_element(tok, top))).alias("parts"), (ok & times.isNotNull()).alias("ok")
        )
        return F.when(F.startswith(tok, F.lit(")")), close).when(tok == "(", open_).otherwise(plain)

    end = F.aggregate(F.reverse(tokens), start, step)
    return _bound(end, lambda s: F.when(s["ok"] & (F.size(s["stack"]) == 1), s["parts"]))


def parsed_formula(formula: Column) -> Column:
    """array<struct<element, amount>> of a formula string, NULL when it does not parse.

    Square and curly brackets count as round ones. Elements may repeat in the result;
    ``to_composition`` adds them up.
    """
    text = F.translate(F.regexp_replace(formula, r"\s", ""), "[]{}", "()()")
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))

    def parts(t: Column) -> Column:
        found = F.when(t["text"].rlike(r"[()]"), _nested_parts(t["tokens"])).otherwise(_flat_parts(t["tokens"]))
        return F.when(F.array_join(t["tokens"], "") == t["text"], found)

    read = _bound(F.struct(text.alias("text"), tokens.alias("tokens")), parts)
    return _bound(read, lambda p: F.when(F.size(p) > 0, p))


def unparsed(df: DataFrame, formula: str) -> DataFrame:
    """Rows whose formula is present but does not parse."""
    return df.where(F.col(formula).isNotNull() & parsed_formula(F.col(formula)).isNull())


def to_composition(df: DataFrame, row_id: str, formula: str, strict: bool = False) -> DataFrame:
    """Formula column to the long table (row_id, element, amount).

    NULL formulas give no rows. One that does not parse gives no rows in tolerant
    mode and fails the job in strict mode.
    """
    parts = parsed_formula(F.col(formula))
    if strict:
        failure = F.raise_error(F.concat(F.lit("formula does not parse: "), F.col(formula))).cast(_PARTS)
        parts = F.when(F.col(formula).isNotNull(), F.coalesce(parts, failure))
    # The outer form keeps the planner from adding filters that parse every formula again.
    flat = df.select(F.col(row_id).alias("row_id"), F.inline_outer(parts)).where(F.col("element").isNotNull())
    return flat.groupBy("row_id", "element").agg(F.sum("amount").alias("amount"))


def symbols_in(text: Column) -> Column:
    """Every capitalised symbol occurring in a text, parsed or not."""
    return F.regexp_extract_all(text, F.lit("([A-Z][a-z]?)"), F.lit(1))


def _bags(comp: DataFrame) -> DataFrame:
    """One row per material with its sorted bag; as wide as the material has elements."""
    return comp.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("element", "amount"))).alias("bag"))


def gcd_of(amounts: Column) -> Column:
    """Greatest common divisor of an array of whole numbers (Euclid; 92 rounds cover 63-bit amounts)."""

    def euclid(x: Column, y: Column) -> Column:
        done = F.aggregate(
            F.sequence(F.lit(1), F.lit(92)),
            F.struct(x.alias("a"), y.alias("b")),
            lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))),
        )
        return done["a"]

    # Dividing by the smallest first leaves few rounds to most bags.
    return F.aggregate(
        F.array_sort(amounts), F.lit(0).cast("bigint"),
        lambda g, x: F.when(g == 1, g).when(g == 0, x).when(F.try_mod(x, g) == 0, g).otherwise(euclid(x, g)),
    )


def reduced_key(comp: DataFrame) -> DataFrame:
    """(row_id, key): the composition divided by its greatest common divisor.

    A bag with a fractional amount cannot be reduced and keeps its amounts.
    """
    bags = _bags(comp)

    def scaled(t: Column) -> Column:
        return F.transform(
            t["bag"],
            lambda e: F.concat(
                e["element"], F.lit(":"),
                F.when(t["whole"], (F.floor(e["amount"]) / t["g"]).cast("bigint").cast("string")).otherwise(
                    F.format_string("%.6f", e["amount"])
                ),
            ),
        )

    def divided(t: Column) -> Column:
        g = F.when(t["whole"], gcd_of(F.transform(t["bag"], lambda e: e["amount"].cast("bigint"))))
        return _bound(F.struct(t["bag"].alias("bag"), t["whole"].alias("whole"), g.alias("g")), scaled)

    whole = F.forall("bag", lambda e: (e["amount"] == F.floor(e["amount"])) & (e["amount"] > 0) & (e["amount"] < 2.0**63))
    shown = _bound(F.struct(F.col("bag"), whole.alias("whole")), divided)
    return bags.select("row_id", F.array_join(shown, " ").alias("key"))


def atom_count(comp: DataFrame) -> DataFrame:
    """(row_id, num_atoms)."""
    return comp.groupBy("row_id").agg(F.sum("amount").alias("num_atoms"))


def fractions(comp: DataFrame) -> DataFrame:
    """(row_id, element, amount, fraction): shares of the row's total amount."""
    total = F.sum("amount").over(Window.partitionBy("row_id"))
    return comp.select("row_id", "element", "amount", (F.col("amount") / F.nullif(total, F.lit(0.0))).alias("fraction"))


def vocabulary(comp: DataFrame) -> DataFrame:
    """Distinct elements."""
    return comp.select("element").distinct()


def fraction_matrix(comp: DataFrame, vocab: list[str]) -> DataFrame:
    """Wide fractions, one column per vocabulary entry, 0.0 where absent.

    Elements outside ``vocab`` keep their share of the denominator and get no column.
    """
    cols = [F.sum(F.when(F.col("element") == v, F.col("amount")).otherwise(0.0)).alias(v) for v in vocab]
    sums = comp.groupBy("row_id").agg(F.sum("amount").alias("_total"), *cols)
    return sums.select("row_id", *[(F.col(f"`{v}`") / F.nullif(F.col("_total"), F.lit(0.0))).alias(v) for v in vocab])


def reindexed(matrix: DataFrame, vocab: list[str], id_col: str = "row_id") -> DataFrame:
    """Carry a matrix to another vocabulary by column name: missing 0.0, extras dropped."""
    have = set(matrix.columns)
    return matrix.select(id_col, *[F.col(f"`{v}`") if v in have else F.lit(0.0).alias(v) for v in vocab])


def only_known(comp: DataFrame, known: DataFrame) -> DataFrame:
    """Keep the rows all of whose elements occur in ``known`` (column element)."""
    stray = comp.join(known, "element", "left_anti").select("row_id").distinct()
    return comp.join(stray, "row_id", "left_anti")


# The category of a material and the elements that decide it.
CATEGORY_ELEMENTS = {
    "Chalcogenides": ("S", "Se", "Te"),
    "Oxides": ("O",),
    "Halides": ("F", "Cl", "Br", "I"),
    "Nitrides": ("N",),
    "Phosphides": ("P",),
    "Arsenides": ("As",),
    "Antimonides": ("Sb",),
    "Silicides": ("Si",),
    "Carbides": ("C",),
    "Hydrides": ("H",),
}
MANY, NONE = "multi", "Others"


def categories(comp: DataFrame, mapping: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(row_id, category): the one category an element set meets, ``multi`` for
    several, ``Others`` for none. One pass, no join: a flag per category."""
    mapping = CATEGORY_ELEMENTS if mapping is None else mapping
    flags = [
        F.max(F.when(F.col("element").isin(*els), F.lit(cat))).alias(f"_c{i}")
        for i, (cat, els) in enumerate(mapping.items())
    ]
    names = F.array_compact(F.array(*[F.col(f"_c{i}") for i in range(len(mapping))]))
    return (
        comp.groupBy("row_id")
        .agg(*flags)
        .select(
            "row_id",
            F.when(F.size(names) == 0, NONE).when(F.size(names) > 1, MANY).otherwise(F.get(names, F.lit(0))).alias("category"),
        )
    )


def element_set_key(comp: DataFrame) -> DataFrame:
    """(row_id, system): the sorted element set, amounts ignored."""
    return comp.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("element")), "-").alias("system"))


def element_groups(comp: DataFrame, groups: DataFrame) -> DataFrame:
    """(row_id, groups): the sorted set of groups its elements belong to.
    ``groups`` has element, grp."""
    return (
        comp.join(groups, "element")
        .groupBy("row_id")
        .agg(F.array_join(F.array_sort(F.collect_set("grp")), "-").alias("groups"))
    )
