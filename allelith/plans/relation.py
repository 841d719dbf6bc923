"""Operators as declarative relations: one definition, planned by Spark over DataFrames, or written out as plain SQL.

An `Op` is a SELECT with named inputs in braces. Called with DataFrames it gives a DataFrame: Catalyst sees one logical
plan and prunes, pushes down and orders joins across operators. `sql()` writes the same relation for a single-node SQL
engine, with all inputs as common table expressions down to the base tables; the two differ only in the macros below.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..store import stored

#: Spellings in the two dialects; {0}, {1}, ... are the macro's arguments.
MACROS = {
    "spark": {
        "each": "explode(sequence(cast({0} as bigint), cast({1} as bigint)))",
        "unnest": "explode({0})",
        "range": "(select id from range({0}))",
        "joined": "listagg({0}, '') within group (order by {1})",
        "split": "split({0}, '{1}')",
        "lnfact": "aggregate(sequence(1, cast(greatest({0}, 1) as int)), 0D, (a, x) -> a + ln(x))",
        "rint": "rint({0})",
        "strip": "regexp_replace({0}, '{1}', '')",
        "sorted": "array_sort({0})",
        "at": "element_at({0}, cast({1} as int))",
        "list": "array_sort(collect_list({0}))",
        "size": "size({0})",
        "text": "array_join({0}, '{1}')",
        "extract": "regexp_extract({0}, '{1}', {2})",
        "place": "cast(array_position({0}, {1}) as bigint)",
        "bit": "(shiftright({0}, cast({1} as int)) & 1)",
        "hash": "(({0}) * 2654435761 % 4294967296)",
        "times": "repeat({0}, cast({1} as int))",
        "any": "bool_or({0})",
        "all": "bool_and({0})",
        "poseach": "posexplode({0}) as ({1}, {2})",
        # the lookahead lets a piece run on into the next one; each base is looked at a fixed number of times
        "pieces": "regexp_extract_all({0}, concat('(?=(.{{{{1,', {1} + {2}, '}}}})).{{{{1,', {1}, '}}}}'), 1)",
        "digits": "translate({0}, 'acgt', '0123')",
        "strip_other": "regexp_replace({0}, '[^0-3]', '0')",
        "array": "array({0})",
        "argmax": "max_by({0}, {1})",
        "within": "size(array_except({0}, {1})) = 0",
        # the bit of an individual in its word of 62
        "power": "shiftleft(cast(1 as bigint), cast({0} % 62 as int))",
        "numbers": "array_join(cast({0} as array<string>), ',')",
        "framed_code": "array_join(collect_list({0}) over ({1}), '')",
        # strings of a window's frame, joined in its order
        "framed": "array_join(collect_list({0}) over ({1}), '')",
        # 61 bases in two numbers; {2} is a window's place from 1 on, {3} its length
        "packed": "cast(conv(rpad(substr({0}, 1, 31), 31, '0'), 4, 10) as bigint) as {1}, cast(conv(rpad(substr({0}, 32, 30), 30, '0'), 4, 10) as bigint) as {2}",
        "window": lambda hi, lo, p, k: (
            f"(case when {p} <= {32 - int(k)} then shiftright({hi}, cast(2 * ({32 - int(k)} - {p}) as int)) else shiftleft({hi}, cast(2 * ({p} - {32 - int(k)}) as int)) | shiftright({lo}, cast(60 - 2 * ({p} - {32 - int(k)}) as int)) end & {4 ** int(k) - 1})"
        ),
        # {1} says what becomes of a character b at place J, from 0 on
        "mapped": lambda x, e: f"array_join(transform(split({x}, ''), (b, j) -> {e.replace('J', 'cast(j as bigint)')}), '')",
    },
    "duckdb": {
        "each": "unnest(generate_series({0}, {1}))",
        "unnest": "unnest({0})",
        "range": "(select range as id from range({0}))",
        "joined": "string_agg({0}, '' order by {1})",
        "split": "string_split({0}, '{1}')",
        "lnfact": "lgamma(cast({0} as double) + 1)",
        "rint": "round_even({0}, 0)",
        "strip": "regexp_replace({0}, '{1}', '', 'g')",
        "sorted": "list_sort({0})",
        "at": "list_extract({0}, cast({1} as int))",
        "list": "list_sort(list({0}))",
        "size": "len({0})",
        "text": "array_to_string({0}, '{1}')",
        "extract": "regexp_extract({0}, '{1}', {2})",
        "place": "cast(list_position({0}, {1}) as bigint)",
        "bit": "((({0}) >> cast({1} as int)) & 1)",
        "hash": "(({0}) * 2654435761 % 4294967296)",
        "times": "repeat({0}, cast({1} as int))",
        "any": "bool_or({0})",
        "all": "bool_and({0})",
        "poseach": "generate_subscripts({0}, 1) - 1 as {1}, unnest({0}) as {2}",
        "pieces": "list_transform(generate_series(0, (length({0}) - 1) // {1}), lambda j: substr({0}, {1} * j + 1, {1} + {2}))",
        "digits": "translate({0}, 'acgt', '0123')",
        "strip_other": "regexp_replace({0}, '[^0-3]', '0', 'g')",
        "array": "[{0}]",
        "argmax": "arg_max({0}, {1})",
        "within": "list_has_all({1}, {0})",
        "power": "(cast(1 as bigint) << cast({0} % 62 as int))",
        "numbers": "array_to_string({0}, ',')",
        "framed_code": "string_agg({0}, '') over ({1})",
        "framed": "coalesce(string_agg({0}, '') over ({1}), '')",
        "packed": "{0} as {1}, {0} as {2}",
        "window": lambda hi, lo, p, k: "(" + " + ".join(f"cast(substr({hi}, cast({p} as int) + {j}, 1) as bigint) * {4 ** (int(k) - 1 - j)}" for j in range(int(k))) + ")",
        "mapped": lambda x, e: f"array_to_string(list_transform(string_split({x}, ''), lambda b, j: {e.replace('J', '(j - 1)')}), '')",
    },
}


def expand(text: str, dialect: str) -> str:
    """text with each @name(a; b) written in the dialect; macros may nest."""
    out, i = [], 0
    for m in re.finditer(r"@(\w+)\(", text):
        if m.start() < i:
            continue
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        args = [expand(a.strip(), dialect) for a in _arguments(text[m.end() : k - 1])]
        macro = MACROS[dialect][m[1]]
        out += [text[i : m.start()], macro(*args) if callable(macro) else macro.format(*args)]
        i = k
    return "".join(out) + text[i:]


def _arguments(text: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == ";" and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]


class Op:
    """A relation over named inputs. `bind` names what an input stands for when the whole is written as SQL or run by name."""

    def __init__(self, name: str, inputs: str, text: str, doc: str = "", kept: bool = False, **bind: Op | str) -> None:
        self.name, self.inputs, self.text, self.__doc__, self.kept = name, inputs.split(), text, doc, kept
        self.bind: dict[str, Op | str] = bind

    def __call__(self, *frames: DataFrame, **named: DataFrame) -> DataFrame:
        given = dict(zip(self.inputs, frames, strict=False)) | named
        if missing := [x for x in self.inputs if x not in given]:
            raise TypeError(f"{self.name} needs {', '.join(missing)}")
        return next(iter(given.values())).sparkSession.sql(expand(self.text, "spark"), **given)

    def over(self, **bind: Op | str) -> Op:
        """The same operator with inputs bound to relations, or to base tables by name."""
        return Op(self.name, " ".join(self.inputs), self.text, self.__doc__ or "", self.kept, **(self.bind | bind))

    def once(self) -> Op:
        """The same relation, written out where several others read it, so that none computes it again."""
        return Op(self.name, " ".join(self.inputs), self.text, self.__doc__ or "", True, **self.bind)

    def uses(self, found: dict[int, int] | None = None) -> dict[int, int]:
        """How often each relation below this one is read, by id."""
        found = {} if found is None else found
        for x in self.inputs:
            if not isinstance(b := self.bind.get(x, x), str):
                if id(b) not in found:
                    found[id(b)] = 0
                    b.uses(found)
                found[id(b)] += self.text.count(f"{{{x}}}")
        return found

    def frame(self, table: Callable[[str], DataFrame], shared: dict[int, DataFrame] | None = None) -> DataFrame:
        """The relation over base tables. Relations marked `once` that are read more than once are written and read again; with
        `shared` all of them below this one are, and what is in it already is taken from there."""
        uses, made = self.uses(), {}

        def make(op: Op) -> DataFrame:
            if shared and id(op) in shared:
                return shared[id(op)]
            if id(op) not in made:
                df = op(**{x: table(b) if isinstance(b := op.bind.get(x, x), str) else make(b) for x in op.inputs})
                if op.kept and op is not self and (shared is not None or uses[id(op)] > 1):
                    df = stored(df, op.name)
                    if shared is not None:
                        shared[id(op)] = df
                made[id(op)] = df
            return made[id(op)]

        return make(self)

    def sql(self) -> str:
        names: dict[int, str] = {}
        parts: list[str] = []

        def write(op: Op) -> str:
            if id(op) not in names:
                refs = {x: b if isinstance(b := op.bind.get(x, x), str) else write(b) for x in op.inputs}
                names[id(op)] = f"r{len(parts)}_{op.name}"
                parts.append(f"{names[id(op)]} as {'materialized ' * op.kept}({expand(op.text, 'duckdb').format(**refs)})")
            return names[id(op)]

        last = write(self)
        return "with " + ",\n".join(parts) + f"\nselect * from {last}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give fewer splits than there are cores, as one small file does; else as it is. The rows are
    the same either way; a table large enough for a cluster has a split for each core and is never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def state(spark: SparkSession, folder: str) -> tuple:
    """What tells whether the tables in a folder are the same as before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


class Registry(dict):
    """Query name -> bound operator."""

    def __init__(self) -> None:
        super().__init__()
        self.shared: dict[tuple, tuple[SparkSession, dict[int, DataFrame]]] = {}
        self.by_hand: dict[str, str] = {}

    def add(self, name: str, op: Op) -> Op:
        self[name] = op
        return op

    def queries(self, share: bool = True) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        """With share, what is marked `once` (an index, paths, counts) is written once a session and input, as an index is, and read by
        every query after that; else each query makes it anew."""

        def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            # texts are what a single task would be long over; all other tables are narrow
            return spread(df.select("doc_id", "text")) if name == "documents" else df

        def run(op: Op) -> Callable[[SparkSession, str], DataFrame]:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                kept = None
                if share:
                    # the session is kept with its results, so that no other can have its id
                    kept = self.shared.setdefault((spark.sparkContext.applicationId, id(spark), sf_dir, state(spark, sf_dir)), (spark, {}))[1]
                return op.frame(lambda t: table(spark, sf_dir, t), kept)

            return query

        return {name: run(op) for name, op in self.items()}

    def oracle_sql(self) -> dict[str, str]:
        """The operators' own SQL, but where some was written by hand."""
        return {name: op.sql() for name, op in self.items()} | self.by_hand
