"""Every rule on small examples: (name, path, lines, rule id, findings expected)."""

import pytest
from conftest import changed_lines

from difflens.functions import values as V
from difflens.operators import findings as fd
from difflens.operators import registry


def numbered(*lines):
    return {i + 1: line for i, line in enumerate(lines)}


LONG = "\t" + "x" * 140
X = {}  # rule -> extra expectations, filled below
CASES = [
    ("lower case id", "Test.cs", {10: "\t\tint customerId = 0;"}, "CS-NAME-001", 1),
    ("upper case id", "Test.cs", {10: "\t\tint customerID = 0;"}, "CS-NAME-001", 0),
    ("classId allowed", "Test.cs", {10: "var x = classId;"}, "CS-NAME-001", 0),
    ("only the first word counts", "Test.cs", {1: "classId = userId;"}, "CS-NAME-001", 0),
    ("comment skipped", "Test.cs", {10: "\t\t// int customerId = 0;"}, "CS-NAME-001", 0),
    ("private field", "Test.cs", {5: "\t\tprivate int customerID;"}, "CS-NAME-002", 1),
    ("private underscore", "Test.cs", {5: "\t\tprivate int _customerID;"}, "CS-NAME-002", 0),
    ("private value", "Test.cs", {5: "private int value;"}, "CS-NAME-002", 0),
    ("hungarian", "Test.cs", {20: "\t\tint iCustomer = 0;"}, "CS-NAME-003", 1),
    ("hungarian string", "Test.cs", {20: "string strName;"}, "CS-NAME-003", 1),
    ("hungarian float", "Test.cs", {20: "float fRate;"}, "CS-NAME-003", 1),
    ("var number", "Test.cs", {15: "\t\tvar count = 0;"}, "CS-NAME-004", 1),
    ("var string", "Test.cs", {15: '\t\tvar name = "";'}, "CS-NAME-004", 1),
    ("var new", "Test.cs", {15: "\t\tvar customer = new Customer();"}, "CS-NAME-004", 0),
    ("public field", "Test.cs", {1: "public string Label;"}, "CS-NAME-005", 1),
    ("public event", "Test.cs", {1: "public event Handler Changed;"}, "CS-NAME-005", 0),
    ("long cs line", "Test.cs", {10: LONG}, "CS-STYLE-001", 1),
    ("200 characters", "Service.cs", {1: "        " + "x" * 192}, "CS-STYLE-001", 1),
    ("138 characters", "Service.cs", {1: "x" * 138}, "CS-STYLE-001", 0),
    ("tabs count four", "Service.cs", {1: "a\t" + "x" * 135}, "CS-STYLE-001", 1),
    ("tab at the limit", "Service.cs", {1: "a\t" + "x" * 134}, "CS-STYLE-001", 0),
    ("this qualifier", "Test.cs", {10: "\t\tthis.customerID = value;"}, "CS-STYLE-002", 1),
    ("this GetType", "Test.cs", {10: "this.GetType();"}, "CS-STYLE-002", 0),
    ("no brace", "Test.cs", numbered("if (a)", "Run();"), "CS-STYLE-003", 1),
    ("brace", "Test.cs", numbered("if (a)", "{"), "CS-STYLE-003", 0),
    ("comment below", "Test.cs", numbered("else", "// x"), "CS-STYLE-003", 0),
    ("gap below", "Test.cs", {1: "if (a)", 3: "Run();"}, "CS-STYLE-003", 0),
    ("entity framework", "Test.cs", {10: "\t\tprivate DbContext _context;"}, "CS-STYLE-004", 1),
    ("entity framework any case", "Test.cs", {10: "x.SAVECHANGES();"}, "CS-STYLE-004", 1),
    ("async void", "Service.cs", {5: "\t\tpublic async void DoSomething()"}, "CS-ASYNC-001", 1),
    ("async task", "Service.cs", {5: "\t\tpublic async Task DoSomethingAsync()"}, "CS-ASYNC-001", 0),
    ("event handler", "Form.cs", {15: "\t\tprivate async void OnButtonClick(object sender)"}, "CS-ASYNC-001", 0),
    ("async name", "Service.cs", {10: "\t\tpublic async Task GetData()"}, "CS-ASYNC-002", 1),
    ("async name generic", "Service.cs", {10: "async ValueTask<int> Get<T>()"}, "CS-ASYNC-002", 1),
    ("async name fine", "Service.cs", {10: "\t\tpublic async Task GetDataAsync()"}, "CS-ASYNC-002", 0),
    ("async Main", "Service.cs", {10: "static async Task Main(string[] a)"}, "CS-ASYNC-002", 0),
    ("magic number", "Service.cs", {20: "\t\tint timeout = 3600;"}, "CS-MAGIC-001", 1),
    ("minus two", "Service.cs", {20: "Wait(-2);"}, "CS-MAGIC-001", 1),
    ("hundred", "Service.cs", {20: "Wait(100);"}, "CS-MAGIC-001", 0),
    ("half", "Service.cs", {20: "Wait(0.5);"}, "CS-MAGIC-001", 0),
    ("const", "Service.cs", {20: "\t\tconst int MaxRetries = 3;"}, "CS-MAGIC-001", 0),
    ("number in string", "Service.cs", {20: 'Say("42"); // 43'}, "CS-MAGIC-001", 0),
    ("array size", "Service.cs", {20: "var a = new int[12];"}, "CS-MAGIC-001", 0),
    ("attribute", "Service.cs", {20: "[MaxLength(255)]"}, "CS-MAGIC-001", 0),
    ("outer join", "Test.sql", {10: "\tLEFT OUTER JOIN CustomerUser cu ON cu.a = c.a"}, "SQL-FMT-003", 1),
    ("left join", "Test.sql", {10: "\tLEFT JOIN CustomerUser cu ON cu.a = c.a"}, "SQL-FMT-003", 0),
    ("dbo", "Test.sql", {10: "\tINSERT INTO [dbo].[Customer] (customerID) VALUES (1)"}, "SQL-FMT-004", 1),
    ("dbo in create", "Test.sql", {10: "create table [dbo].[Customer] (id INT)"}, "SQL-FMT-004", 0),
    ("long sql line", "Test.sql", {10: LONG}, "SQL-FMT-001", 1),
    ("double blank", "Test.sql", {1: "A", 5: "", 9: "  ", 10: "B"}, "SQL-FMT-002", 1),
    ("blank after comment", "Test.sql", numbered("", "-- x", ""), "SQL-FMT-002", 0),
    ("extra spaces", "Test.sql", {1: "SELECT a  FROM T"}, "SQL-FMT-005", 1),
    ("extra spaces in string", "Test.sql", {1: "SELECT 'a  b' FROM T"}, "SQL-FMT-005", 0),
    ("extra spaces before comment", "Test.sql", {1: "SELECT a  -- b"}, "SQL-FMT-005", 0),
    ("keyword", "Test.sql", {1: "select NAME FROM T"}, "SQL-FMT-006", 1),
    ("mixed case keyword passes", "Test.sql", {1: "Select NAME FROM T"}, "SQL-FMT-006", 0),
    ("two-word keyword", "Test.sql", {1: "SELECT A FROM T Order By A"}, "SQL-FMT-006", 1),
    ("identity", "Test.sql", {10: "\tSELECT @customerID = @@IDENTITY"}, "SQL-BP-001", 1),
    ("scope identity", "Test.sql", {10: "\tSELECT @customerID = SCOPE_IDENTITY()"}, "SQL-BP-001", 0),
    ("not is null", "Test.sql", {10: "\tIF (NOT @someArgument IS NULL)"}, "SQL-BP-002", 1),
    ("update alias", "Test.sql", {1: "update c SET c.x = 1"}, "SQL-BP-003", 1),
    ("update table", "Test.sql", {1: "UPDATE Cust SET x = 1"}, "SQL-BP-003", 0),
    ("if without parenthesis", "Test.sql", {1: "IF @a > 0"}, "SQL-BP-004", 1),
    ("if with parenthesis", "Test.sql", {1: "IF (@a > 0)"}, "SQL-BP-004", 0),
    ("no rollback", "Proc.sql", numbered("BEGIN TRANSACTION", "  UPDATE Users SET A = 1", "COMMIT"), "SQL-BP-005", 1),
    ("rollback", "Proc.sql", numbered("BEGIN TRAN", "IF @@ERROR <> 0", "  ROLLBACK"), "SQL-BP-005", 0),
    ("begin and tran apart", "Proc.sql", numbered("BEGIN", "TRAN"), "SQL-BP-005", 0),
    ("select star", "Query.sql", {5: "\tSELECT * FROM Users"}, "SQL-PERF-001", 1),
    ("select top star", "Query.sql", {5: "\tSELECT TOP 10 * FROM Users"}, "SQL-PERF-001", 1),
    ("select columns", "Query.sql", {5: "\tSELECT Id, Name FROM Users"}, "SQL-PERF-001", 0),
    ("cursor", "Proc.sql", {10: "\tDECLARE myCursor CURSOR FOR"}, "SQL-PERF-002", 1),
    ("variable", "Proc.sql", {10: "\tDECLARE @myVar INT"}, "SQL-PERF-002", 0),
    ("password", "Config.cs", {10: '\t\tstring password = "SuperSecret123";'}, "SEC-002", 1),
    ("password in json", "a.json", {10: 'password = "abcdefgh1"'}, "SEC-002", 1),
    ("password in ts is not covered", "a.ts", {10: 'password = "abcdefgh1"'}, "SEC-002", 0),
    ("injection", "Service.cs", {10: '\t\tsql.ExecuteStoredProcedure("GetUser" + userInput);'}, "SEC-003", 1),
    ("sql literal", "Service.cs", {10: 'var q = "SELECT a WHERE id = " + id;'}, "SEC-003", 1),
    ("exact suffix case", "Service.CS", {10: 'var q = "SELECT a WHERE id = " + id;'}, "SEC-003", 0),
    ("sensitive file", "appsettings.Production.json", {4: "b", 1: "some content"}, "SEC-001", 1),
    ("web.config", "Web/Web.config", {1: "x"}, "SEC-001", 1),
    ("security todo", "a.sql", {1: "// TODO: check auth token"}, "SEC-005", 1),
    ("security todo outside comment", "a.cs", {1: "x(); // TODO: auth"}, "SEC-005", 0),
    ("log password", "AuthService.cs", {8: '\t\tlogger.Info("Password: " + password);'}, "SEC-006", 1),
    ("log token", "TokenService.cs", {12: '\t\tlog.Debug($"Token={apiToken}");'}, "SEC-006", 1),
    ("log apiToken only", "TokenService.cs", {12: "log.Debug(apiToken);"}, "SEC-006", 0),
    ("log plain", "AuthService.cs", {5: '\t\tlogger.Info("User logged in successfully");'}, "SEC-006", 0),
    ("log in tsx not covered", "a.tsx", {5: "console.log(token)"}, "SEC-006", 0),
    ("large change", "a.cs", {i: "x();" for i in range(1, 52)}, "GEN-001", 1),
    ("fifty lines", "a.sql", {i: "X" for i in range(1, 51)}, "GEN-001", 0),
    ("console write", "Web/Service.cs", {10: '\t\tConsole.WriteLine("debug");'}, "GEN-002", 1),
    ("console write in tests", "Tests.Core/SomeTest.cs", {10: '\t\tConsole.WriteLine("debug");'}, "GEN-002", 0),
    ("debugger", "Service.cs", {10: "\t\tDebugger.Break();"}, "GEN-003", 1),
    ("if debug", "Service.cs", {10: "#if DEBUG"}, "GEN-003", 1),
    ("dead code", "a.cs", numbered("// var a;", "// return b;", "// if (c)", "d();"), "GEN-004", 1),
    ("dead code at the end", "a.cs", numbered("d();", "// var a;", "// return b;", "// if (c)"), "GEN-004", 1),
    ("dead code over a gap", "a.cs", {1: "// var a;", 5: "// return b;", 9: "// if (c)", 10: "x"}, "GEN-004", 1),
    ("two dead lines", "a.cs", numbered("// var a;", "// return b;", "x", "// if (c)"), "GEN-004", 0),
    ("empty catch", "a.cs", {1: "catch (Exception) { }"}, "GEN-005", 1),
    ("catch with body", "a.cs", {1: "catch { Log(); }"}, "GEN-005", 0),
    ("console.log", "src/service.ts", numbered('  console.log("debug");'), "TS-001", 1),
    ("console.warn", "src/service.ts", numbered("console.warn('x');"), "TS-001", 1),
    ("test file", "src/service.test.ts", numbered('console.log("test");'), "TS-001", 0),
    ("spec file", "src/__tests__/service.spec.ts", numbered('console.log("test");'), "TS-001", 0),
    ("latest.ts counts as test", "src/latest.ts", numbered('console.log("x");'), "TS-001", 0),
    ("comment", "src/service.ts", numbered("// console.log('x')"), "TS-001", 0),
    ("block comment start is code here", "src/service.ts", numbered("/* console.log('x') */"), "TS-001", 1),
    ("js file", "src/utils.js", numbered("console.debug(obj);"), "TS-001", 1),
    ("cs file", "file.cs", numbered("console.debug(obj);"), "TS-001", 0),
    ("any", "src/api.ts", numbered("function foo(x: any) {}"), "TS-003", 1),
    ("generic any", "src/api.ts", numbered("const arr: Array<any> = [];"), "TS-003", 1),
    ("any in comment", "src/api.ts", numbered("// param: any"), "TS-003", 0),
    ("any in js", "src/api.js", numbered("function foo(x: any) {}"), "TS-003", 0),
    ("any in tsx", "src/api.tsx", numbered("function foo(x: any) {}"), "TS-003", 1),
    ("await", "src/service.ts", numbered("async function f() {", "  const d = await api.get('/u');", "}"), "TS-002", 1),
    ("await in try", "src/service.ts", numbered("try {", "  const d = await g('/u');", "} catch (e) { }"), "TS-002", 0),
    ("try over lines", "src/service.ts", numbered("x; try", "", "  { await g('/u');"), "TS-002", 0),
    ("retry is not try", "src/service.ts", numbered("retry", "{", "await g();"), "TS-002", 1),
    ("try then other line", "src/service.ts", numbered("try", "x", "{", "await g();"), "TS-002", 1),
    ("await in comment", "src/service.ts", numbered("// await something()"), "TS-002", 0),
    ("unused import", "src/c.ts", numbered("import { Foo, Bar } from './t';", "const x = new Bar();"), "TS-004", 1),
    ("used import", "src/c.ts", numbered("import { Foo } from './t';", "const y: Foo = null;"), "TS-004", 0),
    ("renamed import", "src/c.ts", numbered("import { Foo as F, Bar as B } from './t';", "Foo();"), "TS-004", 1),
    ("default import", "src/c.ts", numbered("import React from 'react';"), "TS-004", 0),
    ("two-word import used", "src/c.ts", numbered("import { type Foo } from 'a';", "let x: type Foo;"), "TS-004", 0),
    ("two-word import unused", "src/c.ts", numbered("import { type Foo } from 'a';", "let x: Foo; type"), "TS-004", 1),
    ("odd import", "src/c.ts", numbered("import { $a, $a } from 'a';"), "TS-004", 2),
    ("unicode", "Service.cs", {1: '\t\tstring greeting = "Héllo Wörld — こんにちは";  // x'}, "CS-NAME-001", 0),
]


@pytest.fixture(scope="module")
def by_case(spark):
    lines = changed_lines(spark, [(path, text) for _, path, text, _, _ in CASES])
    found = {}
    for row in fd.find(lines).collect():
        found.setdefault((row.pr_id, row.rule_id), []).append(row)
    return found


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[3]} {c[0]}" for c in CASES])
def test_rule(by_case, i):
    name, path, lines, rule_id, expected = CASES[i]
    assert len(by_case.get((i, rule_id), [])) == expected


def test_severities_and_texts(by_case):
    for (_, rule_id), rows in by_case.items():
        for row in rows:
            assert row.severity == V.RULES[rule_id][0]
            assert row.message and "{0}" not in row.message


def _of(by_case, name):
    i = [c[0] for c in CASES].index(name)
    return by_case[(i, CASES[i][3])]


@pytest.mark.parametrize(
    "name, fix",
    [
        ("lower case id", "\t\tint customerID = 0;"),
        ("private field", "\t\tprivate int _customerID;"),
        ("this qualifier", "\t\tcustomerID = value;"),
        ("async void", "\t\tpublic async Task DoSomething()"),
        ("outer join", "\tLEFT JOIN CustomerUser cu ON cu.a = c.a"),
        ("identity", "\tSELECT @customerID = SCOPE_IDENTITY()"),
        ("not is null", "\tIF (@someArgument IS NOT NULL)"),
    ],
)
def test_fix(by_case, name, fix):
    (row,) = _of(by_case, name)
    assert row.suggested_fix == fix and row.original_line is not None


def test_messages(by_case):
    assert _of(by_case, "lower case id")[0].message.startswith("`customerId` should use uppercase `ID` (e.g., `customerID`).")
    assert "(144 chars)" in _of(by_case, "long cs line")[0].message
    assert "{ get; set; }" in _of(by_case, "public field")[0].message
    assert "`Order By` should be uppercase: `ORDER BY`" in _of(by_case, "two-word keyword")[0].message
    assert "(51 lines modified)" in _of(by_case, "large change")[0].message
    assert _of(by_case, "dead code")[0].message.endswith("version control preserves history.")
    assert _of(by_case, "dead code at the end")[0].message.endswith("instead of commenting it out.")
    assert _of(by_case, "dead code at the end")[0].line_no == 2
    assert _of(by_case, "sensitive file")[0].line_no == 1
    assert "`Foo`" in _of(by_case, "unused import")[0].message
    assert _of(by_case, "console.log")[0].original_line == '  console.log("debug");'


def test_ranges_do_not_change_findings(spark, by_case):
    """The same findings when files are cut into ranges of two lines."""
    lines = changed_lines(spark, [(path, text) for _, path, text, _, _ in CASES])
    whole = sorted(tuple(r) for rows in by_case.values() for r in rows if r.rule_id in ("GEN-004", "SQL-FMT-002", "TS-002"))
    for size in (1, 2, 3):
        cut = fd.find(lines, {"GEN-004", "SQL-FMT-002", "TS-002"}, size=size).collect()
        assert sorted(map(tuple, cut)) == whole


def test_own_rule(spark):
    @registry.line_rule("MY-001", "Mine", severity="error", message="no `{0}`", suffixes=[".css", ".cs"])
    def no_goto(ln):
        from pyspark.sql import functions as F

        return registry.Hit(ln.has("goto"), (F.lit("goto"),))

    try:
        lines = changed_lines(spark, [("a.cs", {1: "goto x;"}), ("a.css", {1: "goto"}), ("a.ts", {1: "goto"})])
        rows = fd.find(lines, {"MY-001"}).collect()
        assert sorted((r.pr_id, r.message, r.severity) for r in rows) == [(0, "no `goto`", "error"), (1, "no `goto`", "error")]
    finally:
        registry.LINE_RULES.pop()


@pytest.fixture
def own_rules():
    """An own file rule and an own window rule, each in a class of its own, and a window rule among the built-in ones."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    kinds = (registry.LINE_RULES, registry.FILE_RULES, registry.WINDOW_RULES)
    sizes = [len(k) for k in kinds]

    @registry.file_rule(
        "MY-010", "Migrations", severity="error", message="{0} drops, first in line {1}", suffixes=[".sql", ".mig"],
        flags={"drops": lambda ln: ln.has_ci("drop table")},
        measures=lambda flag: {"n": F.count_if(flag("drops")), "at": F.min(F.when(flag("drops"), F.col("line_no")))},
    )
    def many_drops(f):
        """Too many tables dropped.

        Second paragraph."""
        return registry.FileHit(f.measured["n"] > 1, (f.measured["n"], f.measured["at"]), line=f.measured["at"])

    def repeated(lines, size):
        before = F.lag("content").over(Window.partitionBy("pr_id", "file_idx").orderBy("line_no"))
        hits = lines.filter("filled").withColumn("again", before == F.col("content"))
        return hits, registry.Found(F.col("again"), (F.trim("content"),), original=F.col("content"))

    filled = {"filled": lambda ln: ln.text != ""}
    registry.window_rule("MY-020", "Echoes", severity="warning", message="`{0}` again", suffixes=[], flags=filled)(repeated)
    registry.window_rule(
        "MY-030", "CSharpStyleRules", branch=9, severity="suggestion", message="twice `{0}`", flags=filled
    )(repeated)
    yield
    for kind, n in zip(kinds, sizes):
        del kind[n:]


OWN_CASES = [
    ("a.sql", numbered("x", "DROP TABLE a", "", "drop table b", "drop table b")),
    ("b.MIG", numbered("drop table a", "drop table c")),
    ("c.sql", numbered("drop table a", "DROP")),
    ("d.cs", numbered("drop table a", "drop table a", "var x = 4;", "drop table a")),
]


def test_own_file_and_window_rules(spark, own_rules):
    lines = changed_lines(spark, OWN_CASES)
    rows = fd.find(lines, {"MY-010", "MY-020", "MY-030"}).collect()
    got = sorted((r.pr_id, r.rule_id, r.line_no, r.severity, r.message) for r in rows)
    assert got == [
        (0, "MY-010", 2, "error", "3 drops, first in line 2"),
        (0, "MY-020", 5, "warning", "`drop table b` again"),
        (1, "MY-010", 1, "error", "2 drops, first in line 1"),
        (3, "MY-020", 2, "warning", "`drop table a` again"),
        (3, "MY-030", 2, "suggestion", "twice `drop table a`"),
    ]
    order = [r.rule_id for r in sorted(rows, key=lambda r: tuple(r[c] for c in registry.EMISSION_ORDER)) if r.pr_id == 3]
    assert order == ["MY-030", "MY-020"]  # the built-in class comes first


def test_flags_are_computed_once_and_then_read(spark, own_rules):
    lines = changed_lines(spark, [(path, text) for _, path, text, _, _ in CASES] + OWN_CASES)
    flagged = registry.with_flags(lines)
    declared = {registry.flag_name(r, f) for r in (*registry.FILE_RULES, *registry.WINDOW_RULES) for f in r.flags}
    assert declared <= set(flagged.columns) and "flag_MY-010_drops" in declared
    assert registry.with_flags(flagged) is flagged
    ids = {r.rule_id for r in (*registry.FILE_RULES, *registry.WINDOW_RULES)}
    assert sorted(map(tuple, fd.find(flagged, ids).collect())) == sorted(map(tuple, fd.find(lines, ids).collect()))
    # Rules on staged lines read the flags, not the text.
    wrong = flagged.withColumn("content", registry.F.lit("x"))
    blank = fd.find(wrong, {"SQL-FMT-002", "SQL-BP-005", "GEN-004", "MY-010"})
    assert blank.count() == fd.find(lines, {"SQL-FMT-002", "SQL-BP-005", "GEN-004", "MY-010"}).count() > 0
    # Lines staged before a rule was registered get its flags when it runs.
    older = flagged.drop("flag_MY-010_drops")
    assert fd.find(older, {"MY-010"}).count() == 2


def test_lines_outside_the_languages_of_a_rule_have_no_flags(spark):
    lines = registry.with_flags(changed_lines(spark, [("a.cs", {1: "BEGIN TRAN"}), ("a.sql", {1: "BEGIN TRAN"})]))
    assert [r[0] for r in lines.orderBy("pr_id").select("`flag_SQL-BP-005_begins`").collect()] == [None, True]


def test_flags_must_not_hide_the_columns_of_a_line():
    with pytest.raises(ValueError, match="MY-040"):
        registry.window_rule("MY-040", "Mine", severity="error", message="x", flags={"path": lambda ln: ln.path == ""})


def test_own_rules_in_the_catalogue(spark, own_rules):
    rows = {r.class_name: r for r in registry.rule_catalogue(spark).collect()}
    assert len(rows) == 16 and rows["CSharpStyleRules"].file_types == ["C#"]
    assert rows["Migrations"].file_types == ["SQL"] and rows["Migrations"].description == "Too many tables dropped."
    assert rows["Echoes"].file_types == ["C#", "SQL", "JS/TS"] and rows["Echoes"].description == "`{0}` again"
    assert rows["Migrations"].rule_ord == rows["Echoes"].rule_ord == 15


def test_catalogue(spark):
    rows = registry.rule_catalogue(spark).collect()
    assert len(rows) == 14
    types = {r.class_name: r.file_types for r in rows}
    assert types["SecurityRules"] == ["C#", "SQL"] and types["SensitiveDataLoggingRules"] == ["C#", "JS/TS"]
