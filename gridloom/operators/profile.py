"""Column profiles: counts, distincts, samples, type votes and key signals.

Cells are made long once and grouped as they are, by column and raw value, before anything is
measured: text is built, normalized and tested once per distinct value and not per cell. A second
grouping by normalized value gives one row per column and value, and everything else is computed from
those rows. The columns of a table are told apart by numbers; their names are added at the end.

A table of more than :data:`CELLS` cells is counted and dealt to as many tasks as that takes, which each
group the values of their own rows; only these are moved again, to the second grouping. Sizes of
shuffles don't tell how many values a task will hold, as alike values are packed to a few bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.apparent import ACCEPTANCE, BIT, FLAGS, PRIORITY, type_mask
from gridloom.functions.cells import BOOLEAN, DATETIME, NUMBER, TEXT, Cell, as_ntz, cells_of, column, number_text, time_text
from gridloom.functions.stages import staged
from gridloom.functions.text import header_key, normalize_text, text_length, trim_ws

# Thresholds of the profile.
MAX_SAMPLES = 20
MAX_OPTIONS = 50
IDENTIFYING = 0.95
REPEATED = 0.5
REPEATED_MIN_PRESENT, REPEATED_MIN_DISTINCT = 10, 2
# Header words that suggest a type.
HEADER_HINTS = {
    "email": ("email", "correo", "mail", "e_mail"),
    "phone": ("telefono", "tel", "celular", "movil", "whatsapp", "phone", "contacto"),
    "date": ("fecha", "date", "dia"),
}
# Header words that name a business identifier.
IDENTITY_WORDS = (
    "ruc", "nit", "cedula", "dni", "nif", "cif", "cuit", "rfc", "curp", "codigo", "cod", "id",
    "placa", "patente", "matricula", "serie", "sku", "folio", "numero", "nro",
)
#: Longer texts are measured cell by cell and longer keys grouped by their digest, so that long
#: texts are not shuffled whole.
DIGEST_OVER = 256
#: Columns up to which the first values of a table (51 each at most) are broadcast.
MAX_BROADCAST_COLUMNS = 4_096

#: Cells whose values one task groups.
CELLS = 500_000

COLUMN = ("table", "column", "position")
BUCKET = "__bucket"


# The slots of a cell: text, number, whole number, decimal as text, boolean, time. One is filled.
SLOTS = {
    "v_s": "string", "v_n": "double", "v_w": "bigint", "v_x": "string", "v_b": "boolean", "v_t": "timestamp_ntz",
}


@dataclass(frozen=True)
class LongCells:
    """Cells as rows: ``keys`` tell the column, ``row`` its place, and ``slots`` the raw value.

    ``named`` turns the keys of a frame into table, column and position, which it puts first. With
    several ``tasks``, the rows are dealt to these and have their number.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    slots: tuple[str, ...]
    named: Callable[[DataFrame], DataFrame]
    tasks: int = 1


def _hashed(kind: T.DataType) -> bool:
    """Whether values of this type can be hashed."""
    return not any(name in kind.simpleString() for name in ("map<", "variant"))


def dealt(df: DataFrame, width: Column | int) -> tuple[DataFrame, int, list[str]]:
    """``df`` dealt evenly to tasks of some CELLS cells each, the number of tasks, and the column that
    has the task's number, if there are several. ``width`` is the number of cells of a row."""
    cells = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    tasks = ceil(cells / CELLS)
    if tasks < 2:
        return df, 1, []
    hashed = [column(f.name) for f in df.schema if _hashed(f.dataType)]
    number = F.pmod(F.xxhash64(*hashed), F.lit(tasks)).cast("int")
    return df.withColumn(BUCKET, number).repartitionById(tasks, F.col(BUCKET)), tasks, [BUCKET]


def _slot(value: Column, kind: T.DataType) -> tuple[str, Column]:
    """Where a value of an ordinary column goes."""
    if isinstance(kind, T.BooleanType):
        return "v_b", value
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "v_t", as_ntz(value, kind)
    if isinstance(kind, T.FloatType):
        return "v_n", value.cast("string").cast("double")
    if isinstance(kind, T.DoubleType):
        return "v_n", value
    if isinstance(kind, T.DecimalType):
        return "v_x", value.cast("string")
    if isinstance(kind, T.NumericType):
        return "v_w", value.cast("bigint")
    return "v_s", value.cast("string")


def long_cells(df: DataFrame, table: str, row: str, columns: list[str] | None = None) -> LongCells:
    """The cells of an ordinary table."""
    columns = columns or [c for c in df.columns if c != row]
    types = {field.name: field.dataType for field in df.schema}
    filled = {c: _slot(column(c), types[c]) for c in columns}
    slots = tuple(s for s in SLOTS if any(s == slot for slot, _ in filled.values()))

    def cell(position: int, name: str) -> Column:
        slot, value = filled[name]
        values = [(value if s == slot else F.lit(None)).cast(SLOTS[s]).alias(s) for s in slots]
        return F.struct(F.lit(position).alias("position"), *values)

    df, tasks, bucket = dealt(df.select(*[column(c) for c in dict.fromkeys([row, *columns])]), len(columns))
    # An array knows that a slot may be null if it is in any of the columns; unpivot takes that from the
    # first column, and tests for null are then left out of the plan.
    rows = df.select(
        *bucket, column(row).cast("bigint").alias("row"), F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))
    )
    names = F.array(*[F.lit(c) for c in columns])

    def named(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.lit(table).alias("table"), F.get(names, F.col("position")).alias("column"), "position",
            *[c for c in frame.columns if c != "position"],
        )

    return LongCells(rows, ("position",), slots, named, tasks)


def columns_of(spark: SparkSession, tables: dict[str, list[str]]) -> DataFrame:
    """table, column and position of tables whose columns are known; nothing is read."""
    rows = [(table, c, i) for table, columns in tables.items() for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "table string, column string, position int")


def _text(slots: tuple[str, ...]) -> Column:
    """The text of a cell from its slots; null for a blank one."""
    made = {
        "v_s": lambda: F.nullif(trim_ws(F.col("v_s")), F.lit("")),
        "v_n": lambda: number_text(F.col("v_n")),
        "v_w": lambda: F.col("v_w").cast("string"),
        "v_x": lambda: F.when(F.contains(F.col("v_x"), F.lit(".")), F.rtrim(F.rtrim(F.col("v_x"), F.lit("0")), F.lit("."))).otherwise(F.col("v_x")),
        "v_b": lambda: F.col("v_b").cast("string"),
        "v_t": lambda: time_text(F.col("v_t")),
    }
    return F.coalesce(*[F.when(F.col(s).isNotNull(), made[s]()) for s in slots])


def _mask(slots: tuple[str, ...], text: Column) -> Column:
    whole = F.lit(BIT["integer"] | BIT["decimal"])
    made = {
        "v_s": lambda: type_mask(Cell(TEXT, text)),
        "v_n": lambda: type_mask(Cell(NUMBER, text, number=F.col("v_n"))),
        "v_w": lambda: whole,
        "v_x": lambda: F.when(F.contains(text, F.lit(".")), BIT["decimal"]).otherwise(whole),
        "v_b": lambda: type_mask(Cell(BOOLEAN, text, flag=F.col("v_b"))),
        "v_t": lambda: type_mask(Cell(DATETIME, text, time=F.col("v_t"))),
    }
    chosen = F
    for slot in slots:
        chosen = chosen.when(F.col(slot).isNotNull(), made[slot]())
    return chosen


def _key(slots: tuple[str, ...], text: Column) -> Column:
    if "v_s" not in slots:
        return F.lower(text)
    return F.when(F.col("v_s").isNotNull(), normalize_text(text)).otherwise(F.lower(text))


def _distinct_cells(long: LongCells, digest: bool, counted: bool) -> DataFrame:
    """One row per column and raw value: keys, key, and with ``counted`` also n, first_row, length and mask.

    With ``digest``, long texts are measured before they are grouped, and grouped by digest.
    """
    def short(key: Column) -> Column:
        return F.when(F.length(key) > DIGEST_OVER, F.sha2(key, 256)).otherwise(key) if digest else key

    rows, slots, early = long.rows, long.slots, digest and "v_s" in long.slots
    extra: list[str] = []
    if early:
        is_long = F.octet_length("v_s") > DIGEST_OVER
        others = [c for c in rows.columns if c != "v_s"]
        rows = rows.select(
            *others, F.when(~is_long, F.col("v_s")).alias("v_s"), F.when(is_long, trim_ws(F.col("v_s"))).alias("long_text")
        )
        text, there = F.col("long_text"), F.col("long_text") != ""
        rows = rows.select(
            *others, "v_s", F.when(there, normalize_text(text)).alias("long_key"),
            F.when(there, text_length(text)).alias("long_length"), F.when(there, type_mask(Cell(TEXT, text))).alias("long_mask"),
        )
        rows = rows.withColumn("long_key", short(F.col("long_key")))
        extra = ["long_key", "long_length", "long_mask"]
    # The rows of a bucket are in one task, so this grouping moves none.
    groups = [*([BUCKET] if long.tasks > 1 else []), *long.keys, *slots, *extra]
    if not counted:
        reduced = rows.select(*groups).distinct()
    else:
        reduced = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    kept = [*long.keys, *(["n", "first_row"] if counted else [])]
    texts = staged(reduced.select(*kept, *slots, *extra, _text(slots).alias("text")))
    text = F.col("text")

    def either(late: Column, early_name: str) -> Column:
        return F.coalesce(F.col(early_name), late) if early else late

    texts = texts.withColumn("made_key", F.when(text.isNotNull(), _key(slots, text)))
    key = either(short(F.col("made_key")), "long_key").alias("key")
    if not counted:
        return _moved(long, texts.select(*kept, key))
    length = either(F.when(text.isNotNull(), text_length(text)), "long_length").alias("length")
    mask = either(F.when(text.isNotNull(), _mask(slots, text)), "long_mask").alias("mask")
    return _moved(long, staged(texts.select(*kept, key, length, mask)))


def _moved(long: LongCells, cells: DataFrame) -> DataFrame:
    """Equal keys of a large table together, in as many tasks as its rows."""
    return cells if long.tasks < 2 else cells.repartition(long.tasks, *long.keys, "key")


def value_stats(long: LongCells, digest: bool = False) -> DataFrame:
    """One row per column and normalized value; blank cells share the null key."""
    cells = _distinct_cells(long, digest, counted=True)
    flags = [
        F.sum(F.when(F.col("key").isNotNull(), F.getbit(F.col("mask"), F.lit(i)) * F.col("n")).otherwise(0)).alias(f"n_{name}")
        for i, name in enumerate(FLAGS)
    ]
    return long.named(
        cells.groupBy(*long.keys, "key").agg(
            F.sum("n").alias("n"), F.min("first_row").alias("first_row"), F.max("length").alias("max_len"), *flags
        )
    )


def merge_stats(*parts: DataFrame) -> DataFrame:
    """The statistics of all rows from those of batches, as :func:`value_stats` gives them.

    Rows must be numbered through the batches. Spellings of samples are not part of the state.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    sums = [F.sum(f"n_{name}").alias(f"n_{name}") for name in FLAGS]
    return rows.groupBy(*COLUMN, "key").agg(
        F.sum("n").alias("n"), F.min("first_row").alias("first_row"), F.max("max_len").alias("max_len"), *sums
    )


def value_sets(long: LongCells) -> DataFrame:
    """The distinct non-empty normalized values of every column."""
    keys = _distinct_cells(long, digest=False, counted=False)
    return long.named(keys.where(F.col("key") != "").distinct())


def profiles(stats: DataFrame) -> DataFrame:
    """One row per column: counts, type vote and key signals."""
    filled = F.col("key").isNotNull()
    counted = stats.groupBy(*COLUMN).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("empty"),
        F.count("key").alias("distinct"),
        F.coalesce(F.max("max_len"), F.lit(0)).alias("max_len"),
        *[F.sum(f"n_{name}").alias(f"n_{name}") for name in FLAGS],
    )
    return vote(counted)


def _any_word(words: tuple[str, ...]) -> str:
    return f"(^|_)({'|'.join(words)})($|_)"


def vote(counted: DataFrame) -> DataFrame:
    """Type by share of fitting cells, with the header as a tie-break, and the key signals."""
    present = F.col("total") - F.col("empty")
    hint = F.lit(None).cast("string")
    for name, words in reversed(HEADER_HINTS.items()):
        hint = F.when(F.col("header_key").rlike(_any_word(words)), name).otherwise(hint)

    def share(name: str) -> Column:
        return F.lit(1.0) if name == "text" else F.col(f"n_{name}") / F.col("present")

    hinted = F.lit(None).cast("struct<type:string,confidence:double>")
    for name in HEADER_HINTS:
        hinted = F.coalesce(
            hinted,
            F.when((F.col("hint") == name) & (share(name) >= ACCEPTANCE), _guess(name, share(name))),
        )
    ladder = [F.when(share(n) >= ACCEPTANCE, _guess(n, share(n))) for n in PRIORITY]
    none = _guess("text", F.lit(0.0))
    guess = F.when(F.col("present") == 0, none).otherwise(F.coalesce(hinted, *ladder))
    ratio = F.when(F.col("present") == 0, 0.0).otherwise(F.col("distinct") / F.col("present"))
    return (
        counted.withColumns({"header_key": header_key(F.col("column")), "present": present})
        .withColumns({"hint": hint, "ratio": ratio})
        .withColumn("guess", guess)
        .select(
            *COLUMN,
            "header_key",
            "total",
            "empty",
            "distinct",
            "ratio",
            "max_len",
            F.col("guess.type").alias("type"),
            F.col("guess.confidence").alias("confidence"),
            (
                (F.col("present") >= REPEATED_MIN_PRESENT)
                & (F.col("distinct") >= REPEATED_MIN_DISTINCT)
                & (F.col("ratio") <= REPEATED)
            ).alias("repeats"),
            ((F.col("present") > 0) & (F.col("ratio") >= IDENTIFYING)).alias("identifying"),
            (
                (F.col("present") > 0)
                & (F.col("ratio") >= IDENTIFYING)
                & F.col("header_key").rlike(_any_word(IDENTITY_WORDS))
            ).alias("identity_candidate"),
            (F.col("n_leading_zero") > 0).alias("has_leading_zero"),
        )
    )


def _guess(name: str, confidence: Column) -> Column:
    return F.struct(F.lit(name).alias("type"), confidence.cast("double").alias("confidence"))


def first_values(stats: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` values of each column in first-seen order.

    The rank is bounded, so Spark drops all but ``limit`` rows per column and task before
    the shuffle.
    """
    seen = Window.partitionBy(*COLUMN).orderBy("first_row")
    return (
        stats.where(F.col("key").isNotNull())
        .select(*COLUMN, F.col("first_row").alias("row"), F.row_number().over(seen).alias("rank"))
        .where(F.col("rank") <= limit)
    )


def spellings(firsts: DataFrame, df: DataFrame, row: str) -> DataFrame:
    """Attach the text of the cell each first value was seen in, then list it per column.

    ``firsts`` has at most a few dozen rows per column, so it is broadcast: the table is read
    once more and never shuffled. Only a table of very many columns leaves that to Spark.
    """
    columns = [c for c in df.columns if c != row]
    cells = cells_of(df, columns)
    wanted = firsts.groupBy("row").agg(
        F.collect_list(F.struct(*COLUMN, "rank")).alias("wanted")
    )
    if len(columns) <= MAX_BROADCAST_COLUMNS:
        wanted = F.broadcast(wanted)
    texts = F.create_map(*[x for c in columns for x in (F.lit(c), cells[c].text)])
    found = (
        df.withColumn("__row", column(row).cast("bigint"))
        .join(wanted.withColumnRenamed("row", "__wanted"), F.col("__row") == F.col("__wanted"))
        .select(texts.alias("texts"), F.explode("wanted").alias("w"))
        .select("w.*", F.col("texts")[F.col("w.column")].alias("text"))
    )
    return listed(found)


def listed(found: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return found.groupBy(*COLUMN).agg(F.transform(ordered, lambda x: x["text"]).alias("samples"))


def profile_table(df: DataFrame, table: str, row: str, columns: list[str] | None = None) -> DataFrame:
    """The whole profile of one table, samples included."""
    columns = columns or [c for c in df.columns if c != row]
    df = df.select(*[column(c) for c in (row, *columns)])
    stats = value_stats(long_cells(df, table, row, columns), digest=True)
    samples = spellings(first_values(stats, MAX_SAMPLES), df, row)
    return profiles(stats).join(samples, list(COLUMN), "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<string>"))
    )


def recovered_options(df: DataFrame, table: str, row: str, columns: list[str] | None = None) -> DataFrame:
    """The closed list of every column with few enough distinct values, in first-seen order."""
    columns = columns or [c for c in df.columns if c != row]
    df = df.select(*[column(c) for c in (row, *columns)])
    firsts = first_values(
        value_stats(long_cells(df, table, row, columns), digest=True), MAX_OPTIONS + 1
    )
    # One more than allowed is enough to see that a column is not a closed list.
    return spellings(firsts, df, row).where(F.size("samples") <= MAX_OPTIONS).withColumnRenamed(
        "samples", "options"
    )


def display_column(profile: DataFrame) -> DataFrame:
    """The column that stands for a record: first text, else first non-boolean, else first."""
    order = (
        F.when(F.col("type") == "text", 0).when(F.col("type") != "boolean", 1).otherwise(2)
    )
    return profile.groupBy("table").agg(
        F.min_by("column", F.struct(order.alias("order"), "position")).alias("display")
    )
