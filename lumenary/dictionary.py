"""The dictionary that skills, roles, categories and pay are looked up in: tables, loaded from a folder or the ones supplied.

Operators take a Dictionary and look words up in its tries and maps, so a query's plan does not
grow with the entries. It is what people have written down, not data: loading checks that it is
at most MOST_ROWS rows a table, as every task gets it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenary import dims
from lumenary.functions.trie import Trie

MOST_ROWS = 500_000
#: Values that a task remembers for a function.
REMEMBERED = 65_536

#: The tables of a folder. Rows count in the order of ord.
TABLES = {
    "skills": "ord int, skill string, related array<string>",
    "aliases": "alias string, skill string",
    "edges": "source string, target string, weight double",
    "transfers": "source string, target string, weight double",
    "prerequisites": "skill string, needs array<string>",
    "synonyms": "role string, phrases array<string>",
    "roles": "ord int, role string, core array<string>",
    "negative": "ord int, role string, weak array<string>, core array<string>",
    "taxonomy": "ord int, category string, parent string, aliases array<string>, keywords array<string>",
    "catalogue": "ord int, source string, id string, label string, categories array<string>",
    "pay_roles": "ord int, phrase string, role string",
    "pay": "ord int, role string, level string, local_low long, local_mid long, local_high long, foreign_low long, foreign_mid long, foreign_high long",
}
PAY = T.StructType([T.StructField("role", T.StringType()), T.StructField("level", T.StringType()), *(T.StructField(f"{a}_{b}", T.LongType()) for a in ("local", "foreign") for b in ("low", "mid", "high"))])

_TOKEN = re.compile("[a-z0-9+#.]+")


def tokens_of(text: str) -> list[str]:
    """Lower-case words of letters, digits and ``+ # .``, as functions.phrases.tokens() has them."""
    return _TOKEN.findall(text.lower())


def label_of(text: str) -> str:
    """A category label as it is compared."""
    return re.sub(r"[^a-z0-9 \t\n\x0b\f\r-]", "", text.lower()).strip(" ")


class Dictionary:
    """Tables by name, as lists of rows."""

    def __init__(self, **tables: list[tuple]) -> None:
        self.rows = {name: tables.get(name, []) for name in TABLES}

    @classmethod
    def supplied(cls) -> Dictionary:
        """The dictionary of lumenary.dims."""
        numbered = lambda rows: [(i, *r) for i, r in enumerate(rows)]
        lists = lambda *names: tuple(map(list, names))
        parent = lambda c: c.rsplit(".", 1)[0] if "." in c else None
        return cls(
            skills=numbered((s, list(r)) for s, r in dims.SKILLS.items()),
            aliases=list(dims.ALIASES.items()),
            edges=list(dims.EDGES),
            transfers=list(dims.TRANSFERS),
            prerequisites=[(s, list(n)) for s, n in dims.PREREQUISITES.items()],
            synonyms=[(r, list(p)) for r, p in dims.ROLE_SYNONYMS.items()],
            roles=numbered((r, list(c)) for r, c in dims.ROLE_CORES.items()),
            negative=numbered((r, *lists(w, c)) for r, (w, c) in dims.NEGATIVE.items()),
            taxonomy=numbered((c, parent(c), *lists(a, k)) for c, a, k in dims.TAXONOMY),
            catalogue=numbered((s, i, lab, list(c)) for s, i, lab, c in dims.CATALOGUE),
            pay_roles=numbered(dims.SALARY_ROLES),
            pay=numbered(dims.SALARIES),
        )

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Dictionary:
        """The dictionary of a folder with a Parquet table of each name; a name that is not among ``tables`` of it is empty."""
        return cls.of({name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()})

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> Dictionary:
        """A dictionary of DataFrames; each may have MOST_ROWS rows."""
        rows = {}
        for name, df in tables.items():
            columns = T.StructType.fromDDL(TABLES[name]).names
            found = df.select(*columns).limit(MOST_ROWS + 1).collect()
            if len(found) > MOST_ROWS:
                raise ValueError(f"{name} has more than {MOST_ROWS} rows")
            rows[name] = sorted(map(tuple, found)) if columns[0] == "ord" else list(map(tuple, found))
        return cls(**rows)

    def save(self, spark: SparkSession, folder: str) -> None:
        for name in TABLES:
            self.table(spark, name).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return frame(spark, self.rows[name], TABLES[name])

    # ------------------------------------------------------------ skills

    @cached_property
    def names(self) -> dict[str, str]:
        """Canonical skills by what they are called, lower case."""
        return {s.lower(): s for _, s, _ in self.rows["skills"]} | {a.lower(): s for a, s in self.rows["aliases"]}

    def canonical(self, raw: str | None) -> str | None:
        """Canonical name of a skill: by alias, by name whatever its case, else as it is written, trimmed."""
        return None if raw is None else self.names.get(raw.strip(" ").lower(), raw.strip(" "))

    def canonical_all(self, raw: list[str | None] | None) -> list[str] | None:
        """Distinct canonical names, in order of first mention; whether two are equal does not depend on case."""
        if raw is None:
            return None
        first: dict[str, str] = {}
        for name in map(self.canonical, raw):
            if name is not None:
                first.setdefault(name.lower(), name)
        return list(first.values())

    @cached_property
    def pairs(self) -> list[tuple[str, str, float, bool]]:
        """(from, to, transferability, related) of all different skills that have something to do with one another.

        A direct transferability counts before its reverse, then a relationship's weight times 0.8 in
        either direction, then 0.4 for skills listed as related.
        """
        direct = {(a, b): w for a, b, w in self.rows["transfers"]}
        edge = {(a, b): w for a, b, w in self.rows["edges"]}
        listed = {(a, b) for _, a, names in self.rows["skills"] for b in names}
        out = []
        for a, b in sorted({p for x, y in (set(direct) | set(edge) | listed) for p in ((x, y), (y, x))}):
            back = (b, a)
            steps = [direct.get((a, b)), direct.get(back), edge.get((a, b), 0) * 0.8, edge.get(back, 0) * 0.8, 0.4 if {(a, b), back} & listed else 0]
            out.append((a, b, next((float(s) for s in steps if s), 0.0), bool({(a, b), back} & (set(edge) | listed))))
        return out

    @cached_property
    def needs(self) -> dict[str, list[str]]:
        return dict(self.rows["prerequisites"])

    # ------------------------------------------------------------ roles

    @cached_property
    def phrases(self) -> dict[str, list[str]]:
        """Phrases of the roles that have synonyms."""
        return dict(self.rows["synonyms"])

    @cached_property
    def cores(self) -> list[tuple[int, str, str, int]]:
        """(ord, role, canonical core skill, core skills of the role)."""
        return [(o, r, self.canonical(s), len(core)) for o, r, core in self.rows["roles"] for s in core]

    @cached_property
    def _profiles(self) -> Trie:
        return Trie((tokens_of(p), o) for o, r, _ in self.rows["roles"] for p in self.phrases.get(r, [r]) if tokens_of(p))

    @cached_property
    def _role_of(self) -> dict[int, str]:
        return {o: r for o, r, _ in self.rows["roles"]}

    def profile(self, title: str | None) -> str | None:
        """Role of the first profile that a title names by its phrases."""
        found = self._profiles.find(tokens_of(title)) if title is not None else ()
        return self._role_of[min(found)] if found else None

    @cached_property
    def _against(self) -> Trie:
        return Trie((p, k) for k, (_, r, _, _) in enumerate(self.rows["negative"]) for p in self.phrases.get(r, [r]))

    def against(self, title: str | None) -> list[int]:
        """Numbers of the negative roles that a title names."""
        return sorted(self._against.find(title.lower())) if title is not None else []

    def points(self, skills: list[str] | None) -> list[int | None]:
        """What each negative role takes off for canonical skills: much weak and little core evidence."""
        have = set(skills or ())
        counts = [(len(have & set(weak)), len(have & set(core))) for _, _, weak, core in self.rows["negative"]]
        return [min(20, 4 * weak) if weak > 2 and core < 2 else None for weak, core in counts]

    @cached_property
    def _core_words(self) -> tuple[Trie, list[tuple[str, str]]]:
        low = sorted({(s.lower(), r) for _, r, s, _ in self.cores})
        return Trie(low), low

    def near_roles(self, word: str) -> list[str]:
        """Roles with a core skill that holds a word or is in it."""
        trie, low = self._core_words
        return sorted(trie.find(word) | {r for s, r in low if word in s})

    # ------------------------------------------------------------ categories

    @cached_property
    def _catalogue(self) -> dict[tuple[str, str], list[str]]:
        out: dict[tuple[str, str], list[str]] = {}
        for _, source, key, label, categories in self.rows["catalogue"]:
            for name in {label_of(key), label_of(label)}:
                out.setdefault((source, name), []).extend(categories)
        return out

    @cached_property
    def _ids(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for _, source, key, _, _ in self.rows["catalogue"]:
            out.setdefault(source, set()).add(key)
        return out

    @cached_property
    def _aliases(self) -> tuple[Trie, list[tuple[str, int]]]:
        rows = [(label_of(a), k) for k, (_, _, _, aliases, _) in enumerate(self.rows["taxonomy"]) for a in aliases]
        return Trie(rows), rows

    @cached_property
    def _keywords(self) -> Trie:
        return Trie((w.lower(), k) for k, (_, _, _, _, words) in enumerate(self.rows["taxonomy"]) for w in words)

    def _named(self, numbers: Iterable[int]) -> list[str]:
        return [self.rows["taxonomy"][k][1] for k in sorted(numbers)]

    def by_label(self, label: str) -> tuple[list[str], list[str]]:
        """Categories by alias, which holds the label or is in it, and by keywords in the label, in order of the taxonomy."""
        name = label_of(label)
        trie, rows = self._aliases
        return self._named(trie.find(name) | {k for a, k in rows if name in a}), self._named(self._keywords.find(label.lower()))

    def categories(self, source: str | None, labels: list[str] | None, title: str | None, skills: list[str] | None, seen: Callable | None = None) -> list[str]:
        """By the source's catalogue, by alias, by keywords of the labels, and by keywords of title and skills; each once, in that order."""
        labels = [x for x in labels or () if x is not None]
        exact = [c for x in labels for c in self._catalogue.get((source, label_of(x)), ())]
        both = [(seen or self.by_label)(x) for x in labels]
        text = " ".join([title or "", " ".join(s for s in skills or () if s is not None)]).lower()
        about = self._named(self._keywords.find(text))
        return list(dict.fromkeys([*exact, *(c for a, _ in both for c in a), *(c for _, k in both for c in k), *about]))

    def valid_labels(self, source: str | None, labels: list[str] | None) -> list[str]:
        """Labels that are ids of the source's catalogue, each once."""
        return list(dict.fromkeys(x for x in labels or () if x in self._ids.get(source, ())))

    # ------------------------------------------------------------ pay

    @cached_property
    def _pay_roles(self) -> Trie:
        return Trie((p, k) for k, (_, p, _) in enumerate(self.rows["pay_roles"]))

    @cached_property
    def _pay(self) -> dict[tuple[str, str | None], tuple]:
        out: dict[tuple[str, str | None], tuple] = {}
        for row in self.rows["pay"]:
            out.setdefault((row[1], row[2]), row[1:])
            out.setdefault((row[1], None), row[1:])
        return out

    def pay(self, title: str | None, level: str | None) -> dict | None:
        """The pay benchmark of the first role that a title contains, at the level or else at the role's first one."""
        found = self._pay_roles.find(title.lower().strip(" ")) if title is not None else ()
        if not found:
            return None
        role = self.rows["pay_roles"][min(found)][2]
        row = self._pay.get((role, dims.LEVEL_OF.get((level or "").upper(), level)), self._pay.get((role, None)))
        return row and dict(zip(PAY.names, row, strict=True))


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as one local relation, handed over as Arrow; its size is known to the optimizer, and no job makes it."""
    kind = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    table = pa.table({f.name: pa.array(list(c), type=to_arrow_type(f.dataType)) for f, c in zip(kind, columns, strict=True)})
    return spark.createDataFrame(table, kind)


def row_function(make: Callable, kind: T.DataType, *columns: Column) -> Column:
    """``make`` of the values of some columns, row by row in Arrow batches; a task remembers what it has made of short rows."""
    arrow = to_arrow_type(kind)
    seen: dict = {}

    def run(*arrays: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(a.to_pylist() for a in arrays), strict=True):
            key = tuple(tuple(v) if isinstance(v, list) else v for v in row)
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[key] = make(*row)
            out.append(seen[key])
        return pa.array(out, type=arrow)

    return F.arrow_udf(run, returnType=kind)(*columns)


SUPPLIED = Dictionary.supplied()
