"""Rule detection as Column expressions.

The 35 rules are stated verbatim below (FIXED VALUES).  On Spark they
compile to Java regexes inside whole-stage codegen; DuckDB (RE2) runs the
same texts in the oracle SQL.

Java's backtracking engine is cubic on the SQL rules (two greedy
``[\\s\\S]*`` wildcards).  The Spark side therefore runs a *staged* form
derived mechanically from each SQL rule: anchor, verb and tail are each
found lazily and committed with an atomic group, with the whole match
anchored at the start of the text.  Any text may stand between the
stages, so committing to the earliest end of each stage is equivalent to
the original pattern, and the search is linear in the text length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: the 35 rules (component variant order), as regex sources.
# (rule_id, family, pattern, case_insensitive)
# ---------------------------------------------------------------------------
RULES = [
    ("SQL1", "sql_injection", r"""\b(sql|query|stmt|statement|command)\s*=\s*f["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\{[^}]+\}""", True),
    ("SQL2", "sql_injection", r"""\b(sql|query|stmt|statement|command)\s*=\s*["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\+\s*[a-z_][\w.\[\]()'"-]*""", True),
    ("SQL3", "sql_injection", r"""\b(sql|query|stmt|statement|command)\s*=\s*["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\.format\s*\(""", True),
    ("SQL4", "sql_injection", r"""\b(sql|query|stmt|statement|command)\s*=\s*["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*%\s*\(?\s*[a-z_]""", True),
    ("SQL5", "sql_injection", r"""(?:cursor\.)?execute\(\s*f["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\{[^}]+\}""", True),
    ("SQL6", "sql_injection", r"""(?:cursor\.)?execute\(\s*["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\+\s*[a-z_]""", True),
    ("SQL7", "sql_injection", r"""(?:cursor\.)?execute\(\s*["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\.format\s*\(""", True),
    ("SQL8", "sql_injection", r"""db\.query\(\s*`[\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\$\{[^}]+\}""", True),
    ("SQL9", "sql_injection", r"""statement\.executequery\(\s*["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\+\s*[a-z_]""", True),
    ("SQL10", "sql_injection", r"""preparestatement\(\s*["'`][\s\S]*\b(select|insert|update|delete|drop|union)\b[\s\S]*\+\s*[a-z_]""", True),
    ("SEC1", "hardcoded_secret", r"""\b(password|passwd|pwd|secret|api[_-]?key|apikey|token|access[_-]?token|refresh[_-]?token|client[_-]?secret|private[_-]?key|secret[_-]?key)\b\s*[:=]\s*["'][^"'\n]{4,}["']""", True),
    ("SEC2", "hardcoded_secret", r"""\b(auth|authorization)\b\s*[:=]\s*["']bearer\s+[a-z0-9._-]+["']""", True),
    ("SEC3", "hardcoded_secret", r"""-----begin (rsa |ec |openssh )?private key-----""", True),
    ("SEC4", "hardcoded_secret", r"""\bAKIA[0-9A-Z]{16}\b""", False),
    ("SEC5", "hardcoded_secret", r"""\bxox[baprs]-[a-z0-9-]{10,}\b""", True),
    ("SEC6", "hardcoded_secret", r"""mongodb(\+srv)?:\/\/[^:\s]+:[^@\s]+@""", True),
    ("SEC7", "hardcoded_secret", r"""postgres(?:ql)?:\/\/[^:\s]+:[^@\s]+@""", True),
    ("SEC8", "hardcoded_secret", r"""createclient\(\s*\{[\s\S]*apikey\s*:\s*["'][^"']+["']""", True),
    ("CRY1", "weak_crypto", r"""hashlib\.md5""", True),
    ("CRY2", "weak_crypto", r"""hashlib\.sha1""", True),
    ("CRY3", "weak_crypto", r"""createHash\(["']md5["']\)""", True),
    ("CRY4", "weak_crypto", r"""createHash\(["']sha1["']\)""", True),
    ("CRY5", "weak_crypto", r"""MessageDigest\.getInstance\(["']MD5["']\)""", True),
    ("CRY6", "weak_crypto", r"""MessageDigest\.getInstance\(["']SHA-?1["']\)""", True),
    ("CRY7", "weak_crypto", r"""DES\.new""", True),
    ("CRY8", "weak_crypto", r"""\b3DES\b""", True),
    ("CRY9", "weak_crypto", r"""\bTripleDES\b""", True),
    ("CRY10", "weak_crypto", r"""\bRC2\b""", True),
    ("CRY11", "weak_crypto", r"""\bRC4\b""", True),
    ("CRY12", "weak_crypto", r"""\bBlowfish\b""", True),
    ("CRY13", "weak_crypto", r"""\bMODE_ECB\b""", True),
    ("CRY14", "weak_crypto", r"""\bAES\/ECB\b""", True),
    ("CRY15", "weak_crypto", r"""Cipher\.getInstance\(["'][^"']*ECB[^"']*["']\)""", True),
    ("CRY16", "weak_crypto", r"""RSA\.generate\(\s*1024""", True),
    ("CRY17", "weak_crypto", r"""\bkey_size\s*=\s*1024\b""", True),
]
# Verdict priority per policy.
COMPONENT_ORDER = ["sql_injection", "weak_crypto", "hardcoded_secret"]
PAGE_ORDER = ["weak_crypto", "sql_injection", "hardcoded_secret"]
NEGATIVE_LABEL = {"component": "safe", "page": "secure"}
# ---------------------------------------------------------------------------

FAMILIES = ["sql_injection", "hardcoded_secret", "weak_crypto"]
ANY_TEXT = r"[\s\S]*"
AT_RUN = r"[^@\s]+@"

# Lower-case substrings a text must contain before a rule can match,
# derived by hand from the rule texts above: per rule, a list of groups;
# the rule needs one substring of every group.  Matching is ASCII
# case-insensitive and lower() maps ASCII letters to ASCII letters, so
# each group is a necessary condition on lower(text): the gate only skips
# regex runs that could not match.  The oracle SQL runs the rules ungated,
# so every oracle comparison also checks the gates.
SQL_ANCHORS = ["sql", "query", "stmt", "statement", "command"]
SQL_VERBS = ["select", "insert", "update", "delete", "drop", "union"]
RULE_NEEDLES = {
    "SQL1": [SQL_ANCHORS, SQL_VERBS, ["{"]],
    "SQL2": [SQL_ANCHORS, SQL_VERBS, ["+"]],
    "SQL3": [SQL_ANCHORS, SQL_VERBS, [".format"]],
    "SQL4": [SQL_ANCHORS, SQL_VERBS, ["%"]],
    "SQL5": [["execute("], SQL_VERBS, ["{"]],
    "SQL6": [["execute("], SQL_VERBS, ["+"]],
    "SQL7": [["execute("], SQL_VERBS, [".format"]],
    "SQL8": [["db.query("], SQL_VERBS, ["${"]],
    "SQL9": [["statement.executequery("], SQL_VERBS, ["+"]],
    "SQL10": [["preparestatement("], SQL_VERBS, ["+"]],
    "SEC1": [["password", "passwd", "pwd", "secret", "api", "token", "private"], [":", "="]],
    "SEC2": [["auth"], ["bearer"]],
    "SEC3": [["-----begin "], ["private key-----"]],
    "SEC4": [["akia"]],
    "SEC5": [["xox"]],
    "SEC6": [["mongodb"], ["://"]],
    "SEC7": [["postgres"], ["://"]],
    "SEC8": [["createclient("], ["apikey"]],
    "CRY1": [["hashlib.md5"]],
    "CRY2": [["hashlib.sha1"]],
    "CRY3": [["createhash("], ["md5"]],
    "CRY4": [["createhash("], ["sha1"]],
    "CRY5": [["messagedigest.getinstance("], ["md5"]],
    "CRY6": [["messagedigest.getinstance("], ["sha"]],
    "CRY7": [["des.new"]],
    "CRY8": [["3des"]],
    "CRY9": [["tripledes"]],
    "CRY10": [["rc2"]],
    "CRY11": [["rc4"]],
    "CRY12": [["blowfish"]],
    "CRY13": [["mode_ecb"]],
    "CRY14": [["aes/ecb"]],
    "CRY15": [["cipher.getinstance("], ["ecb"]],
    "CRY16": [["rsa.generate("], ["1024"]],
    "CRY17": [["key_size"], ["1024"]],
}


# Strict mode (our option): the '%' rule no longer fires on a bare "%s"
# placeholder directly followed by a quote — the parameterised form the
# remediation itself recommends.  Written without look-arounds so that RE2
# runs the same text.
PERCENT_TAIL = r"%\s*\(?\s*[a-z_]"
STRICT_PERCENT_TAIL = r"""%(?:\s*\(\s*[a-z_]|\s+[a-z_]|[a-rt-z_]|s[^"']|s\z)"""


def rules_for(strict: bool = False) -> list[tuple]:
    if not strict:
        return RULES
    return [(rid, fam, pat.replace(PERCENT_TAIL, STRICT_PERCENT_TAIL), ci) for rid, fam, pat, ci in RULES]


# What the rules' own engine takes as white space, and its ASCII word boundary.
SPACES = r"\t\n\x0B\x0C\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
NEUTRAL = "\u00A4"  # neither a letter nor a space, for Java's classes as well


def _spaces(pattern: str) -> str:
    """\\s, in and out of brackets, as the class above."""
    return pattern.replace(r":\s]", f":{SPACES}]").replace(r"@\s]", f"@{SPACES}]").replace(r"\s", f"[{SPACES}]")


def oracle_pattern(pattern: str, case_insensitive: bool) -> str:
    """Pattern text for engines with a linear-time matcher (RE2)."""
    text = ANY_TEXT.join(_spaces(p) for p in pattern.split(ANY_TEXT))
    return ("(?i)" if case_insensitive else "") + text


def java_pattern(pattern: str) -> str:
    """A piece of a rule for Java: the same spaces and word boundaries, no
    backtracking between adjacent runs.

    Two runs of spaces beside an optional bracket never give spaces back.  A
    brace search commits to its first brace with something in it: if no
    closing brace follows that one, none follows a later one.  A quoted run
    with a word in it commits to the word's first place."""
    text = pattern.replace(r"%\s*\(?\s*[a-z_]", r"%\s*+(?:\(\s*+)?[a-z_]")
    text = text.replace("""[^"']*ECB[^"']*""", """(?>[^"']*?ECB)[^"']*+""")
    return text


def staged_pattern(pattern: str, case_insensitive: bool) -> str:
    """Linear-time Java form of a rule.

    Rules with greedy ``[\\s\\S]*`` gaps are cut at the gaps; each stage is
    found lazily and committed atomically, and the match is anchored at
    the start, so the Java engine never backtracks into a gap.
    """
    flag = "(?i)" if case_insensitive else ""
    parts = pattern.split(ANY_TEXT)
    if len(parts) == 1:
        return flag + java_pattern(pattern)
    stages = [r"(?>[\s\S]*?" + java_pattern(p) + ")" for p in parts]
    if parts[-1].endswith(r"\{[^}]+\}"):
        stages[-1] = r"(?>[\s\S]*?" + java_pattern(parts[-1].removesuffix(r"]+\}")) + r"])[^}]*+\}"
    return flag + r"\A" + "".join(stages)


def neutral(code: Column) -> Column:
    """The text with every space that is one for the rules' engine as a plain
    space, and any other sign beyond ASCII as one that is neither space nor
    letter: Java's own ``\\s`` and ``\\b``, which are faster than classes and
    look-arounds, then find what that engine finds.  ASCII texts are as they are."""
    plain = F.regexp_replace(F.regexp_replace(code, f"[{SPACES}&&[^\\x00-\\x7F]]", " "), r"[^\x00-\x7F]", NEUTRAL)
    return F.when(F.octet_length(code) == F.length(code), code).otherwise(plain)


def rule_column(code: Column, rule: tuple) -> Column:
    _, _, pattern, ci = rule
    code = neutral(code)
    if pattern.endswith(AT_RUN):
        # A run without an @, and the rest of a run after its last @, cannot
        # hold what the rule looks for; without them every search for the @
        # that ends a match succeeds at the first one.
        code = F.regexp_replace(code, r"(?<![^@\s])[^@\s]++(?!\S)", "")
    return code.rlike(staged_pattern(pattern, ci))


def _any(low: Column, group: list[str]) -> Column:
    g = None
    for n in group:
        c = low.contains(n)
        g = c if g is None else (g | c)
    return g


def _groups_common(rule_ids: list[str]) -> list[list[str]]:
    """Needle groups shared by every listed rule (tested once for all)."""
    first = RULE_NEEDLES[rule_ids[0]]
    return [g for g in first if all(g in RULE_NEEDLES[r] for r in rule_ids[1:])]


def needle_gate(low: Column, rule_id: str, skip: list[list[str]] | None = None) -> Column | None:
    """Necessary condition of a rule on the lower-cased text (groups in
    `skip` are already tested by the caller)."""
    cond = None
    for group in RULE_NEEDLES[rule_id]:
        if skip and group in skip:
            continue
        g = _any(low, group)
        cond = g if cond is None else (cond & g)
    return cond


def gated_rule(code: Column, rule: tuple, low: Column | None = None, skip: list[list[str]] | None = None) -> Column:
    """The rule's regex, run only where its needles occur (null → false)."""
    low = F.lower(code) if low is None else low
    gate = needle_gate(low, rule[0], skip)
    hit = rule_column(code, rule) if gate is None else (gate & rule_column(code, rule))
    return F.coalesce(hit, F.lit(False))


def family_flag(code: Column, family: str, strict: bool = False) -> Column:
    """True if any rule of the family fires (C1, C2, C3).  Null code → false.
    Rules run one by one (Java matches separate literal-led patterns faster
    than one alternation), each behind its own needle gate; the groups all
    rules of the family share are tested once, in front."""
    low = F.lower(code)
    rules = [r for r in rules_for(strict) if r[1] == family]
    common = _groups_common([r[0] for r in rules])
    cond = None
    for rule in rules:
        c = gated_rule(code, rule, low, common)
        cond = c if cond is None else (cond | c)
    for g in common:
        cond = _any(low, g) & cond
    return F.coalesce(cond, F.lit(False))


def flag_sqli(code: Column) -> Column:
    return family_flag(code, "sql_injection")


def flag_crypto(code: Column) -> Column:
    return family_flag(code, "weak_crypto")


def flag_secret(code: Column) -> Column:
    return family_flag(code, "hardcoded_secret")


def verdict(code: Column, policy: str = "component", strict: bool = False) -> Column:
    """C4 (component: SQL → crypto → secret, else safe) and
    C5 (page: lower-cased input; crypto → SQL → secret, else secure)."""
    order = COMPONENT_ORDER if policy == "component" else PAGE_ORDER
    text = code if policy == "component" else F.lower(code)
    expr = None
    for fam in order:
        cond = family_flag(text, fam, strict)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit(NEGATIVE_LABEL[policy]))


def rule_hit_slots(code: Column, low: Column | None = None) -> Column:
    """Array with one slot per rule (RULES order): the rule id where it
    fires, else null (C7).  Each rule runs once, behind its own needle gate
    (family-shared groups tested once).  Left as slots so that callers drop
    nulls after an explode: a lambda filter here would take the whole rule
    expression out of generated code.  `low` may be a column holding
    lower(code) already."""
    low = F.lower(code) if low is None else low
    hits = []
    for fam in FAMILIES:
        rules = [r for r in RULES if r[1] == fam]
        common = _groups_common([r[0] for r in rules])
        shared = None
        for g in common:
            shared = _any(low, g) if shared is None else (shared & _any(low, g))
        for r in rules:
            hit = gated_rule(code, r, low, common)
            hits.append(F.when(hit if shared is None else (shared & hit), F.lit(r[0])))
    return F.array(*hits)


def rule_family(rule_id: Column) -> Column:
    expr = None
    for rid, fam, _, _ in RULES:
        cond = rule_id == F.lit(rid)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr


# --------------------------- oracle SQL text -------------------------------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_rule(code_sql: str, rule: tuple) -> str:
    _, _, pattern, ci = rule
    return f"regexp_matches({code_sql}, {sql_str(oracle_pattern(pattern, ci))})"


def sql_family_flag(code_sql: str, family: str, strict: bool = False) -> str:
    parts = [sql_rule(code_sql, r) for r in rules_for(strict) if r[1] == family]
    return "coalesce((" + " OR ".join(parts) + "), false)"


def sql_verdict(code_sql: str, policy: str = "component", strict: bool = False) -> str:
    order = COMPONENT_ORDER if policy == "component" else PAGE_ORDER
    text = code_sql if policy == "component" else f"lower({code_sql})"
    whens = " ".join(f"WHEN {sql_family_flag(text, fam, strict)} THEN '{fam}'" for fam in order)
    return f"CASE {whens} ELSE '{NEGATIVE_LABEL[policy]}' END"


def sql_rule_hit_ids(code_sql: str) -> str:
    items = ", ".join(f"CASE WHEN {sql_rule(code_sql, r)} THEN '{r[0]}' END" for r in RULES)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def sql_rule_family(rule_sql: str) -> str:
    whens = " ".join(f"WHEN '{rid}' THEN '{fam}'" for rid, fam, _, _ in RULES)
    return f"CASE {rule_sql} {whens} END"
