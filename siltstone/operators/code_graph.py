"""Code graphs: symbols and edges of source files, references between repositories."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from siltstone.expr.text import repo_variants

EXTRACTORS: dict[str, Callable[[str, str], list[tuple]]] = {}
SYMBOLS = "kind string, name string, target string, edge_type string, line int"


def register_extractor(suffix: str) -> Callable:
    """An extractor takes (path, text) and gives (kind, name, target, edge_type, line): symbols without a target, edges with one."""

    def register(f: Callable[[str, str], list[tuple]]) -> Callable:
        EXTRACTORS[suffix] = f
        return f

    return register


@register_extractor(".py")
def python_symbols(path: str, text: str) -> list[tuple]:
    """Modules, classes, functions and methods; IMPORTS, INHERITS and CALLS edges by the names in the text. Nothing of a file that doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    module = path.removesuffix(".py").replace("/", ".")
    out: list[tuple] = [("Module", module, None, None, 1)]

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else None
        return None

    def visit(node: ast.AST, owner: str, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{child.name}"
                is_class = isinstance(child, ast.ClassDef)
                out.append(("Class" if is_class else "Method" if inside_class else "Function", name, None, None, child.lineno))
                if is_class:
                    out.extend(("edge", name, base, "INHERITS", child.lineno) for b in child.bases if (base := dotted(b)))
                visit(child, name, is_class)
                continue
            if isinstance(child, ast.Import):
                out.extend(("edge", owner, a.name, "IMPORTS", child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.extend(("edge", owner, f"{child.module or ''}.{a.name}".strip("."), "IMPORTS", child.lineno) for a in child.names)
            elif isinstance(child, ast.Call) and (target := dotted(child.func)):
                out.append(("edge", owner, target, "CALLS", child.lineno))
            visit(child, owner, inside_class)

    visit(tree, module, False)
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """(repo, path, kind, name, target, edge_type, line) of files (repo, path, text) of any registered language."""

    def run(batches):
        for pdf in batches:
            rows = [(repo, path, *row) for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["text"], strict=True) for suffix, f in EXTRACTORS.items() if path.endswith(suffix) for row in f(path, text or "")]
            yield pd.DataFrame(rows, columns=["repo", "path", "kind", "name", "target", "edge_type", "line"])

    return files.select("repo", "path", "text").mapInPandas(run, f"repo string, path string, {SYMBOLS}")


_MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|default|readonly|override|export|declare)\s+)*"
_SCRIPT = [
    ("Function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("Function", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    ("Class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("Method", rf"^\s+{_MODIFIERS}(?:async\s+)?(?:get\s+|set\s+)?\*?((?!(?:if|for|while|switch|catch|function|return|constructor)\b)[A-Za-z_$#][\w$]*)\s*\([^;]*\)\s*(?::[^{{]+)?\{{\s*$"),
    ("INHERITS", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+[\w$]+(?:<[^>]*>)?\s+extends\s+([\w$.]+)"),
    ("IMPORTS", r"^\s*(?:import|export)\b[^'\"]*\bfrom\s+['\"]([^'\"]+)['\"]"),
    ("IMPORTS", r"^\s*import\s+['\"]([^'\"]+)['\"]"),
    ("IMPORTS", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"),
]
_TYPED = [("Interface", r"^(?:export\s+)?(?:declare\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("Type", r"^(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\b[^=]*="), ("Enum", r"^(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)")]
#: By suffix: what a line declares, and the pattern whose group is its name. Upper case: an edge to that name.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    ".go": [
        ("Function", r"^func\s+([A-Za-z_]\w*)"),
        ("Method", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)"),
        ("Class", r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\b"),
        ("Interface", r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\b"),
        ("IMPORTS", r"^import\s+(?:[\w.]+\s+)?\"([^\"]+)\""),
        ("IMPORTS", r"^\s+(?:[\w.]+\s+)?\"([^\"]+)\"\s*$"),
    ],
    ".java": [
        ("Class", rf"^\s*{_MODIFIERS}(?:class|record)\s+([A-Za-z_]\w*)"),
        ("Interface", rf"^\s*{_MODIFIERS}@?interface\s+([A-Za-z_]\w*)"),
        ("Enum", rf"^\s*{_MODIFIERS}enum\s+([A-Za-z_]\w*)"),
        ("Method", rf"^\s+{_MODIFIERS}(?:<[^>]+>\s+)?(?!(?:return|new|else|throw)\b)[\w.<>\[\],?]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?\{{"),
        ("INHERITS", rf"^\s*{_MODIFIERS}(?:class|interface)\s+\w+(?:<[^{{]*>)?\s+extends\s+([\w.]+)"),
        ("IMPORTS", r"^import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"),
    ],
    ".js": _SCRIPT,
    ".jsx": _SCRIPT,
    ".mjs": _SCRIPT,
    ".ts": _SCRIPT + _TYPED,
    ".tsx": _SCRIPT + _TYPED,
}


def declared_symbols(files: DataFrame) -> DataFrame:
    """(repo, path, kind, name, target, edge_type, line) of files (repo, path, text) of the languages in DECLARATIONS, from what single lines declare.

    A module for each file; functions, classes, interfaces, types, enums and methods, a method under the
    class that was declared last before it (a Go method under its receiver's type); IMPORTS and INHERITS
    edges. Lines that begin a comment are passed over. Calls aren't resolved. Column expressions only.
    """
    text, path = F.coalesce("text", F.lit("")), F.col("path")
    suffix = F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)
    known = files.where(suffix.isin(*DECLARATIONS)).select("repo", "path", suffix.alias("suffix"), F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), "/", ".").alias("module"), text.alias("text"))
    lines = known.select("repo", "path", "suffix", "module", F.posexplode(F.split("text", "\n")).alias("n", "line_text")).where(~F.col("line_text").rlike(r"^\s*(?://|/\*|\*)"))
    none = F.lit(None).cast("string")

    def found(suffix: str) -> Column:
        return F.array(*[F.struct(F.lit(kind).alias("what"), F.regexp_extract("line_text", pattern, 1).alias("own")) for kind, pattern in DECLARATIONS[suffix]])

    by_suffix = None
    for name in DECLARATIONS:
        by_suffix = F.when(F.col("suffix") == name, found(name)) if by_suffix is None else by_suffix.when(F.col("suffix") == name, found(name))
    marks = lines.withColumn("found", F.filter(by_suffix, lambda x: x["own"] != ""))
    before = Window.partitionBy("repo", "path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holder = F.last(F.try_element_at(F.filter("found", lambda x: x["what"] == "Class"), F.lit(1))["own"], ignorenulls=True).over(before)
    receiver = F.nullif(F.regexp_extract("line_text", r"^func\s+\(\s*(?:\w+\s+)?\*?([A-Za-z_]\w*)", 1), F.lit(""))
    placed = marks.withColumn("holder", F.coalesce(receiver, holder)).select("repo", "path", "module", "n", "holder", F.explode("found").alias("f")).distinct()
    what, own = F.col("f.what"), F.col("f.own")
    edge = what == F.upper(what)
    under = F.when((what == "Method") & F.col("holder").isNotNull(), F.concat_ws(".", "module", "holder", own)).otherwise(F.concat_ws(".", "module", own))
    source = F.when(what == "INHERITS", F.concat_ws(".", "module", "holder")).otherwise(F.col("module"))
    rows = placed.select("repo", "path", F.when(edge, "edge").otherwise(what).alias("kind"), F.when(edge, source).otherwise(under).alias("name"), F.when(edge, own).alias("target"), F.when(edge, what).alias("edge_type"), (F.col("n") + 1).alias("line"))
    modules = known.select("repo", "path", F.lit("Module").alias("kind"), F.col("module").alias("name"), none.alias("target"), none.alias("edge_type"), F.lit(1).alias("line"))
    return modules.unionByName(rows)


def cross_repo_candidates(files: DataFrame, repos: DataFrame, width: int = 200) -> DataFrame:
    """One row for each line of a file that names another repository in one of its spellings.

    Lines are cut into name-like runs, which meet the spellings in an equi-join; nothing is compared pairwise.
    """
    names = repos.select(F.col("full_name").alias("target"), F.explode(repo_variants(F.col("full_name"))).alias("word")).distinct()
    lines = files.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("n", "snippet"))
    words = lines.select("*", F.explode(F.array_distinct(F.regexp_extract_all("snippet", F.lit(r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)?"), F.lit(0)))).alias("run"))
    parts = words.select("repo", "path", "n", "snippet", F.explode(F.array_distinct(F.concat(F.array("run"), F.split("run", "/")))).alias("word"))
    found = parts.join(names, "word").where("repo <> target")
    return found.select(F.col("repo").alias("source_repo"), "target", "path", (F.col("n") + 1).alias("line"), F.substring("snippet", 1, width).alias("snippet"), "word").distinct()
