"""Known languages and how files are recognised."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structsim.functions.names import base_name, extension

# Id, family, extensions, interpreter names.
LANGUAGES = (
    ("bash", "shell", ".bash .sh", "bash dash sh"), ("zsh", "shell", ".zsh", "zsh"), ("c", "c-cpp", ".c .h", ""), ("cpp", "c-cpp", ".cc .cpp .cxx .hh .hpp .hxx", ""),
    ("csharp", "csharp", ".cs", ""), ("dart", "dart", ".dart", ""), ("gdscript", "gdscript", ".gd", ""), ("go", "go", ".go", ""), ("java", "java", ".java", ""),
    ("javascript", "javascript", ".cjs .js .jsx .mjs", "node nodejs"), ("kotlin", "kotlin", ".kt .kts", "kotlin"), ("lua", "lua-luau", ".lua", "lua lua5.1 lua5.2 lua5.3 lua5.4 luajit"),
    ("luau", "lua-luau", ".luau", ""), ("php", "php-hack", ".php .phtml", ""), ("hack", "php-hack", ".hack", ""), ("typescript", "typescript", ".cts .mts .ts", ""), ("tsx", "typescript", ".tsx", ""),
    ("python", "python", ".py .pyi", "python python3"), ("powershell", "powershell", ".ps1 .psd1 .psm1", "powershell pwsh"), ("ruby", "ruby", ".gemspec .rake .rb", "ruby"), ("rust", "rust", ".rs", ""),
    ("swift", "swift", ".swift", ""), ("sql", "sql", ".sql", ""), ("postgresql", "sql", "", ""),
)


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, f, "sql-query" if f == "sql" else "code", "query" if f == "sql" else "function", e.split(), s.split()) for i, f, e, s in LANGUAGES]
    return spark.createDataFrame(rows, "id string, family string, domain string, kind string, extensions array<string>, shebangs array<string>")


def interpreter(first_line: Column) -> Column:
    """Interpreter name of a ``#!`` line of at most 256 bytes, through env with its options; assignments are refused."""
    line = F.regexp_extract(first_line, r"^#![ \t]*(\S[^\r\n]*)", 1)
    words = F.filter(F.split(line, r"[ \t]+"), lambda w: w != "")
    name = F.element_at(F.split(F.element_at(words, 1), "/"), -1)
    rest = F.filter(F.slice(words, 2, 64), lambda w: ~w.startswith("-"))
    after = F.try_element_at(rest, F.lit(1))
    through = F.when(after.contains("="), F.lit(None).cast("string")).otherwise(F.element_at(F.split(after, "/"), -1))
    return F.when((line != "") & (F.octet_length(first_line) <= 256), F.when(name == "env", through).otherwise(name))


def detect_language(files: DataFrame, sql_dialect: str = "sql") -> DataFrame:
    """Adds language, family, domain, kind to files (path, content: string); null where the language is unknown.

    The extension decides; files without one go by their first line. ``.sql`` follows the chosen dialect, and a ``.php``
    file whose first line (or second, after ``#!``) is a hack header is hack. The language table is fixed and small.
    """
    known = languages(files.sparkSession)
    by_extension = known.select(F.explode("extensions").alias("_ext"), F.col("id").alias("_e"))
    by_shebang = known.select(F.explode("shebangs").alias("_int"), F.col("id").alias("_s"))
    head = F.substring(F.coalesce("content", F.lit("")), 1, 600)
    first = F.regexp_extract(head, r"^([^\n]*)", 1)
    out = files.withColumn("_ext", extension("path")).withColumn("_int", F.when(~base_name("path").contains("."), interpreter(first)))
    out = out.join(F.broadcast(by_extension), "_ext", "left").join(F.broadcast(by_shebang), "_int", "left")
    language = F.coalesce("_e", "_s")
    hack = head.rlike(r"^(#![^\n]*\n)?<\?hh[ \t]*(//[^\n]*)?\r?(\n|$)")
    language = F.when((F.col("_ext") == ".sql"), sql_dialect).when((F.col("_ext") == ".php") & hack, "hack").otherwise(language)
    out = out.withColumn("language", language).drop("_ext", "_int", "_e", "_s")
    return out.join(F.broadcast(known.select(F.col("id").alias("language"), "family", "domain", "kind")), "language", "left")


def resolve_selector(selector: str) -> list[str]:
    """The sorted ids of a language id or family; an unknown one is an error."""
    wanted = selector.strip().lower()
    found = sorted(i for i, family, _, _ in LANGUAGES if wanted in (i, family))
    if not found:
        raise ValueError(f"no language or family {selector}")
    return found


def language_pairs(selectors: Iterable[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """All pairs of language ids that pairs of selectors stand for, each sorted, once, in order."""
    return tuple(sorted({tuple(sorted((a, b))) for left, right in selectors for a in resolve_selector(left) for b in resolve_selector(right)}))
