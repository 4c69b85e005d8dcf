"""Rule registry and the evaluation of the three kinds of rules.

* A line rule is a function from the columns of a changed line to a ``Hit``: a predicate, the parts of its message and,
  where it has one, the corrected line. All of a language are evaluated in one projection over its lines; no shuffle and
  no Python worker is involved.
* A file rule declares flags of a line and aggregates of them, and decides on one row a file. All file rules are one
  grouped pass, combined before the shuffle.
* A window rule declares flags of a line and returns a DataFrame of hits made from the lines of its files, with the help
  of ``ordered`` for neighbours and positions.

Flags are computed once, in the projection that stages the lines (``with_flags``); rules then read the flag columns and
not the text. Own rules are added with ``@line_rule``, ``@file_rule`` and ``@window_rule``; their findings follow those
of the built-in groups, or stand among them if they name a built-in group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import files
from .ordered import FILE

FINDING_COLUMNS = [
    "pr_id", "file_idx", "path", "line_no", "rule_id", "severity", "message", "original_line", "suggested_fix",
    "rule_ord", "phase", "emit_pos", "emit_sub",
]
# Findings of one file follow the order rule group, file-level before lines before
# end of file, line, rule within the line.
EMISSION_ORDER = ["file_idx", "rule_ord", "phase", "emit_pos", "emit_sub"]
SUB_STEP = 1_000_000

LANGUAGE_EXTENSIONS = {
    "cs": ["cs"],
    "sql": ["sql"],
    "ts": ["ts", "tsx", "js", "jsx"],
    "config": ["config", "json", "xml", "yml", "yaml"],
    "other": [],
}
GROUP_ORDER = {name: i + 1 for i, (name, _, _) in enumerate(V.RULE_GROUPS)}
GROUP_SUFFIXES = {name: suffixes for name, suffixes, _ in V.RULE_GROUPS}


@dataclass
class Line:
    """Columns a rule may use."""

    content: Column
    text: Column  # stripped
    low: Column  # stripped, lower case
    path: Column
    ascii: Column
    slash_comment: Column  # starts with // or /* or *

    def has(self, *parts: str) -> Column:
        """Cheap test that keeps the regex away from most lines."""
        return _any(F.contains(self.text, F.lit(p)) for p in parts)

    def has_ci(self, *parts: str) -> Column:
        """Same, ignoring case; non-ASCII lines go on to the regex, as folding can differ there."""
        return _any(F.contains(self.low, F.lit(p)) for p in parts) | ~self.ascii


@dataclass
class Hit:
    when: Column
    parts: tuple = ()
    original: Column | None = None
    fix: Column | None = None


@dataclass
class Found(Hit):
    """Hit of a window rule on the rows it returns; ``pos`` and ``sub`` order the findings of a file."""

    pos: Column | None = None  # the line number, if not given
    sub: Column | int = 0
    phase: int = 1  # 0 before the lines of a file, 2 behind them
    template: str | None = None


@dataclass
class File:
    """Columns a file rule may use: one row is the changed lines of a file."""

    path: Column
    n_lines: Column
    first_line: Column
    measured: dict[str, Column]


@dataclass
class FileHit(Hit):
    line: Column | None = None  # the file's first changed line, if not given


@dataclass
class Rule:
    rule_id: str
    group: str
    branch: int
    suffixes: list
    severity: str
    template: str
    build: Callable

    @property
    def group_order(self) -> int:
        return GROUP_ORDER.get(self.group, len(GROUP_ORDER) + 1)


@dataclass
class LineRule(Rule):
    by_line: bool = False


@dataclass
class FileRule(Rule):
    flags: dict[str, Callable[[Line], Column]] = field(default_factory=dict)
    measures: Callable[[Callable[[str], Column]], dict[str, Column]] = lambda flag: {}


@dataclass
class WindowRule(Rule):
    flags: dict[str, Callable[[Line], Column]] = field(default_factory=dict)


LINE_RULES: list[LineRule] = []
FILE_RULES: list[FileRule] = []
WINDOW_RULES: list[WindowRule] = []


def _any(cols: Iterable[Column]) -> Column:
    out = None
    for c in cols:
        out = c if out is None else out | c
    return out


def _register(rules: list, kind, rule_id, group, branch, severity, message, suffixes, **more):
    fixed = V.RULES.get(rule_id, (severity, message))
    reserved = {*FILE, "path", "line_no", "ord", "content"} & set(more.get("flags", ()))
    if reserved:
        raise ValueError(f"{rule_id}: flags named like columns of a line: {sorted(reserved)}")

    def register(build):
        own = suffixes if suffixes is not None else GROUP_SUFFIXES.get(group, [])
        rules.append(kind(rule_id, group, branch, own, severity or fixed[0], message or fixed[1], build, **more))
        return build

    return register


def line_rule(rule_id, group, branch=1, by_line=False, severity=None, message=None, suffixes=None):
    """Register a line rule. Built-in ids take severity and text from the fixed
    values; own rules pass ``severity``, ``message`` and ``suffixes`` and get a
    place behind the built-in groups. ``by_line``: findings come in line-number
    order instead of diff order."""
    return _register(LINE_RULES, LineRule, rule_id, group, branch, severity, message, suffixes, by_line=by_line)


def file_rule(rule_id, group, flags=None, measures=lambda flag: {}, severity=None, message=None, suffixes=None):
    """Register a file rule, a function from ``File`` to ``FileHit``.

    ``flags`` names columns of a line, as functions of ``Line``. ``measures`` gives named aggregates over a file's lines;
    it is handed a function from a flag's name to its column and may use ``line_no`` and ``ord``. Findings come before
    those of the file's lines.
    """
    return _register(FILE_RULES, FileRule, rule_id, group, 0, severity, message, suffixes, flags=flags or {}, measures=measures)


def window_rule(rule_id, group, branch=1, flags=None, severity=None, message=None, suffixes=None):
    """Register a window rule, a function from (lines, range size) to (hits, ``Found`` or a list of them).

    The lines are those of the rule's files: pr_id, file_idx, path, line_no, ord, content and the rule's ``flags``. The
    hits must keep the first four; each ``Found`` whose ``when`` holds on a row of them makes a finding.
    """
    return _register(WINDOW_RULES, WindowRule, rule_id, group, branch, severity, message, suffixes, flags=flags or {})


def _applies(suffixes: list, lang: str, ext: Column, path: Column) -> Column | bool:
    """Whether a rule sees files of a language: no, all of them, or a test per row."""
    if not suffixes:
        return True
    plain = {s[1:] for s in suffixes if s.count(".") == 1 and s.startswith(".")}
    known = {e for exts in LANGUAGE_EXTENSIONS.values() for e in exts}
    own = set(LANGUAGE_EXTENSIONS[lang])
    if lang == "other":
        return files.has_suffix(path, suffixes) if plain - known or len(plain) < len(suffixes) else False
    if len(plain) < len(suffixes):
        return files.has_suffix(path, suffixes)
    if not own & plain:
        return False
    return True if own <= plain else ext.isin(*sorted(own & plain))


def finding_struct(rule_id, group_order, phase, pos, sub, severity, message, original=None, fix=None) -> Column:
    """The part of a finding that a rule decides."""
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        (null if original is None else original).alias("original_line"),
        (null if fix is None else fix).alias("suggested_fix"),
        F.lit(group_order).alias("rule_ord"),
        F.lit(phase).alias("phase"),
        pos.cast("bigint").alias("emit_pos"),
        (sub if isinstance(sub, Column) else F.lit(sub)).cast("bigint").alias("emit_sub"),
    )


def with_language(changed_lines: DataFrame) -> DataFrame:
    return changed_lines if "lang" in changed_lines.columns else changed_lines.withColumn("lang", files.language(F.col("path")))


def line_findings(changed_lines: DataFrame, rule_ids: set | None = None) -> DataFrame | None:
    """All line rules (or the given ones) over changed lines, one pass per language."""
    lines = with_language(changed_lines)
    found = None
    for lang in LANGUAGE_EXTENSIONS:
        part = _language_findings(lines, lang, rule_ids)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return found


def _language_findings(lines: DataFrame, lang: str, rule_ids: set | None) -> DataFrame | None:
    chosen = []
    for rule in LINE_RULES:
        if rule_ids is None or rule.rule_id in rule_ids:
            applies = _applies(rule.suffixes, lang, F.col("ext"), F.col("path"))
            if applies is not False:
                chosen.append((rule, applies))
    if not chosen:
        return None
    prepared = (
        lines.filter(F.col("lang") == lang)
        .select(
            "pr_id", "file_idx", "path", "line_no", "ord", "content",
            T.strip(F.col("content")).alias("text"), files.extension(F.col("path")).alias("ext"),
        )
        .select(
            "*",
            F.lower("text").alias("low"),
            T.is_ascii(F.col("text")).alias("ascii"),
            _any(F.startswith("text", F.lit(p)) for p in ("//", "/*", "*")).alias("slash_comment"),
        )
    )
    line = Line(*[F.col(c) for c in ("content", "text", "low", "path", "ascii", "slash_comment")])
    hits = []
    for rule, applies in chosen:
        hit = rule.build(line)
        when = hit.when if applies is True else applies & hit.when
        pos = F.col("line_no") if rule.by_line else F.col("ord")
        hits.append(
            F.when(
                when,
                finding_struct(
                    rule.rule_id, rule.group_order, 1, pos, rule.branch * SUB_STEP, rule.severity,
                    T.fill(rule.template, *hit.parts), hit.original, hit.fix,
                ),
            )
        )
    # One column per rule, then one row per hit: the rules stay separate pieces of generated
    # code; as arguments of the generator they would be interpreted or one huge method.
    place = ["pr_id", "file_idx", "path", "line_no"]
    per_rule = [f"hit_{i}" for i in range(len(hits))]
    return (
        prepared.select(*place, *[h.alias(n) for h, n in zip(hits, per_rule)])
        .select(*place, F.inline(F.array(*per_rule)))
        .filter(F.col("rule_id").isNotNull())
        .select(*FINDING_COLUMNS)
    )


def _languages(suffixes: list) -> list[str]:
    return [lang for lang in LANGUAGE_EXTENSIONS if _applies(suffixes, lang, F.lit(""), F.lit("")) is not False]


def _in_files(rules: Iterable[Rule]) -> Column:
    """Lines of files that one of the rules sees; the languages stand apart, for partition pruning."""
    langs = sorted({lang for r in rules for lang in _languages(r.suffixes)})
    path = F.col("path")
    tests = []
    for lang in langs:
        applies = [a for r in rules if (a := _applies(r.suffixes, lang, files.extension(path), path)) is not False]
        tests.append(F.col("lang") == lang if any(a is True for a in applies) else (F.col("lang") == lang) & _any(applies))
    return F.col("lang").isin(*langs) & _any(tests)


def flag_name(rule: Rule, name: str) -> str:
    return f"flag_{rule.rule_id}_{name}"


def with_flags(changed_lines: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """``changed_lines`` with the flags that file and window rules (or the given ones) declare, null outside the rule's
    languages. Flags it has already are kept: lines staged before a rule was registered get that rule's flags here."""
    lines = with_language(changed_lines)
    text = F.col("_text")
    line = Line(F.col("content"), text, F.lower(text), F.col("path"), T.is_ascii(text), _any(F.startswith(text, F.lit(p)) for p in ("//", "/*", "*")))
    missing = {
        flag_name(rule, name): F.when(F.col("lang").isin(*_languages(rule.suffixes)), flag(line))
        for rule in ([*FILE_RULES, *WINDOW_RULES] if rules is None else rules)
        for name, flag in rule.flags.items()
        if flag_name(rule, name) not in lines.columns
    }
    # The stripped text is a column of its own, so that it is made once for all flags.
    return lines.withColumn("_text", T.strip(F.col("content"))).withColumns(missing).drop("_text") if missing else lines


def file_findings(changed_lines: DataFrame, rule_ids: set | None = None) -> DataFrame | None:
    """All file rules (or the given ones) in one grouped pass."""
    rules = [r for r in FILE_RULES if rule_ids is None or r.rule_id in rule_ids]
    if not rules:
        return None
    measures = {r.rule_id: r.measures(lambda name, r=r: F.col(flag_name(r, name))) for r in rules}
    per_file = (
        with_flags(changed_lines, rules)
        .filter(_in_files(rules))
        .groupBy(*FILE, "path")
        .agg(
            F.count("*").alias("n_lines"),
            F.min("line_no").alias("first_line"),
            *[c.alias(f"{rid}_{name}") for rid, found in measures.items() for name, c in found.items()],
        )
    )
    hits = []
    for r in rules:
        measured = {name: F.col(f"`{r.rule_id}_{name}`") for name in measures[r.rule_id]}
        hit = r.build(File(F.col("path"), F.col("n_lines"), F.col("first_line"), measured))
        line = F.col("first_line") if getattr(hit, "line", None) is None else hit.line
        struct = finding_struct(
            r.rule_id, r.group_order, 0, F.lit(0), 0, r.severity, T.fill(r.template, *hit.parts), hit.original, hit.fix
        )
        row = F.struct(line.alias("line_no"), *[struct[c].alias(c) for c in FINDING_COLUMNS[4:]])
        hits.append(F.when(files.has_suffix(F.col("path"), r.suffixes) & hit.when, row))
    return (
        per_file.select(*FILE, "path", F.inline(F.array(*hits)))
        .filter(F.col("rule_id").isNotNull())
        .select(*FINDING_COLUMNS)
    )


def window_findings(changed_lines: DataFrame, rule_ids: set | None, size: int) -> list[DataFrame]:
    """Each window rule (or the given ones) over the lines of its files."""
    rules = [r for r in WINDOW_RULES if rule_ids is None or r.rule_id in rule_ids]
    out = []
    for r in rules:
        flags = [F.col(flag_name(r, name)).alias(name) for name in r.flags]
        lines = with_flags(changed_lines, [r]).filter(_in_files([r]))
        hits, found = r.build(lines.select(*FILE, "path", "line_no", "ord", "content", *flags), size)
        structs = []
        for f in found if isinstance(found, list) else [found]:
            sub = (f.sub if isinstance(f.sub, Column) else F.lit(f.sub)) + F.lit(r.branch * SUB_STEP if f.phase == 1 else 0)
            struct = finding_struct(
                r.rule_id, r.group_order, f.phase, F.col("line_no") if f.pos is None else f.pos, sub, r.severity,
                T.fill(f.template or r.template, *f.parts), f.original, f.fix,
            )
            structs.append(F.when(f.when, struct))
        out.append(
            hits.select(*FILE, "path", "line_no", F.inline(F.array(*structs)))
            .filter(F.col("rule_id").isNotNull())
            .select(*FINDING_COLUMNS)
        )
    return out


def rule_catalogue(spark) -> DataFrame:
    """The rule groups with the file types they look at; own groups stand behind the built-in ones, described by the first
    line of their first rule's docstring, or its message without one."""
    groups = {name: (suffixes, summary) for name, suffixes, summary in V.RULE_GROUPS}
    own: dict[str, list[Rule]] = {}
    for rule in [*LINE_RULES, *FILE_RULES, *WINDOW_RULES]:
        if rule.group not in groups:
            own.setdefault(rule.group, []).append(rule)
    for name, rules in own.items():
        suffixes = [] if any(not r.suffixes for r in rules) else [s for r in rules for s in r.suffixes]
        said = (rules[0].build.__doc__ or rules[0].template).strip().splitlines()
        groups[name] = (suffixes, said[0].strip() if said else "")
    probes = [("C#", [".cs"]), ("SQL", [".sql"]), ("JS/TS", [".js", ".ts"])]
    rows = []
    for i, (name, (suffixes, summary)) in enumerate(groups.items()):
        types = [label for label, exts in probes if not suffixes or set(exts) & set(suffixes)]
        rows.append((min(i, len(GROUP_ORDER)) + 1, name, types or ["General"], summary))
    return spark.createDataFrame(rows, "rule_ord int, class_name string, file_types array<string>, description string")
