"""Rule tables for entities and personal data, and category lexicons.

A rule is one pattern for one type. ``needs`` lists texts of which at least one is
part of every match, ``probe`` is a cheaper pattern that every match contains: a
search for them lets most texts skip the pattern itself.
Repetitions are bounded wherever a failed match could be retried from each position,
and a pattern starts with a cheap look at its first characters, so that most positions
of a text are left after one test. A rule with ``one_line`` reads only the lines that hold one
of its ``needs``, as none of its matches goes beyond a line.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

from dossierflow.functions.redaction import replacement_sql
from dossierflow.schemas import CATEGORIES, ENTITY, PII_ITEM, ddl

# ASCII word edges: the built-in \b also counts accented letters as word characters.
START = "(?<![0-9A-Za-z_])"
END = "(?![0-9A-Za-z_])"

MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
PHONE = (
    rf"(?=[+(0-9])(?:\+1[ .-]?|{START}1[ .-])?(?:\([0-9]{{3}}\) ?|{START}[0-9]{{3}}[.-])"
    rf"[0-9]{{3}}[.-][0-9]{{4}}{END}"
)
DATE = (
    rf"(?=[0-9]{{1,4}}[-/]|[JFMASOND]){START}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}"
    rf"|(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}){END}"
)
MONEY = r"(?=[-$])-?\$(?:[0-9]{1,3}(?:,[0-9]{3}){1,6}|[0-9]{1,18})(?:\.[0-9]{2})?"
RATE = rf"(?=[0-9]{{1,3}}[.%]){START}[0-9]{{1,3}}(?:\.[0-9]{{1,4}})?%"
SSN = rf"(?=[0-9*X]{{3}}-)(?:{START}[0-9]{{3}}|\*{{3}}|{START}X{{3}})-(?:[0-9]{{2}}|\*{{2}}|X{{2}})-[0-9]{{4}}{END}"
EIN = rf"(?=[0-9]{{2}}-){START}[0-9]{{2}}-[0-9]{{7}}{END}"
ACCOUNT_LABEL = r"(?=[ACLPM])(?:Account|Card|Loan|Policy|Member) (?:Number|No\.|ID):? ?"
ACCOUNT = rf"{ACCOUNT_LABEL}([0-9A-Z*]{{1,12}}(?:[ -][0-9A-Z*]{{1,12}}){{0,6}}){END}"
CAPITALIZED = r"[A-Z][A-Za-z'.-]{0,30}"
PERSON_LABEL = (
    r"(?=[ABCINP])(?:Account Holder|Primary Borrower|Co-Borrower|Borrower|Name|Insured|Primary|Contingent|Advisor):"
)
PERSON = rf"{PERSON_LABEL} ({CAPITALIZED}(?: {CAPITALIZED}){{1,3}})"
ORGANIZATION_LABEL = r"(?=[BLEIC])(?:Bank|Lender|Employer|Issuer|Company|Institution|Insurer):"
ORGANIZATION = rf"{ORGANIZATION_LABEL} ({CAPITALIZED}(?: {CAPITALIZED}){{0,5}})"
FIRM = (
    rf"(?=[A-Z]){START}([A-Z][A-Za-z&]{{1,30}}(?: [A-Z][A-Za-z&]{{1,30}}){{0,4}} "
    rf"(?:Bank|Inc\.|LLC|Corporation|Insurance Company|Credit Union))"
)
STREET = r"(?:Street|Avenue|Road|Drive|Lane|Boulevard|Way|Court|Plaza)"
ADDRESS = (
    rf"(?=[0-9]{{1,6}} [A-Z]){START}[0-9]{{1,6}} (?:[A-Z][A-Za-z.]{{0,20}} ){{1,4}}{STREET}{END}"
    r"(?:, [A-Z][A-Za-z]{0,20}(?: [A-Z][A-Za-z]{0,20}){0,2})?(?:, [A-Z]{2} [0-9]{5})?"
)
STREET_WORDS = ("Street", "Avenue", "Road", "Drive", "Lane", "Boulevard", "Way", "Court", "Plaza")
CREDIT_SCORE = rf"(?=[CF])(?:Credit Score|FICO Score|FICO): ?([0-9]{{3}}){END}"
PROPERTY = r"(?=[PC])(?:Property Address|Property|Collateral): ([^\r\n]+)"
ROUTING = rf"(?=[RA])(?:Routing Number|ABA Number|ABA): ?([0-9]{{9}}){END}"
LICENSE = rf"(?=D)(?:Driver's License|Driver License): ?([A-Z0-9]{{5,20}}){END}"
BIRTH = rf"(?=D)(?:Date of Birth|DOB): ?({DATE})"
INCOME = rf"(?=[AMSC])(?:Annual Income|Monthly Income|Salary|Compensation): ?({MONEY})"
BALANCE = (
    r"(?=[BEPNC])(?:Beginning Balance|Ending Balance|Previous Balance|New Balance|Current Balance|Balance)"
    rf"[^$\r\n]{{0,20}}({MONEY})"
)
LABEL_NEEDS = ("Holder:", "Borrower:", "Name:", "Insured:", "Primary:", "Contingent:", "Advisor:")


@dataclass(frozen=True)
class Rule:
    """One pattern of an entity type; ``group`` is the part that is the value."""

    type: str
    pattern: str
    confidence: float
    needs: tuple[str, ...] = ()
    group: int = 0
    # A cheap pattern found inside every match, for types without a fixed text.
    probe: str = ""
    # No match holds a line feed or looks across one: each line can be searched alone.
    one_line: bool = field(default=False, kw_only=True)


@dataclass(frozen=True)
class PiiRule(Rule):
    """A rule with the strategy that hides its values."""

    strategy: str = "REDACT"


def _in_lines(*rules):
    return tuple(replace(rule, one_line=True) for rule in rules)


ENTITY_RULES: tuple[Rule, ...] = _in_lines(
    Rule("person", PERSON, 0.85, LABEL_NEEDS, 1),
    Rule("organization", ORGANIZATION, 0.8,
         ("Bank:", "Lender:", "Employer:", "Issuer:", "Company:", "Institution:", "Insurer:"), 1),
    Rule("organization", FIRM, 0.7, (" Bank", " Inc.", " LLC", " Corporation", " Company", " Union"), 1),
    Rule("account_number", ACCOUNT, 0.95, ("Number", "No.", " ID"), 1),
    Rule("ssn_tax_id", SSN, 0.98, ("-",), probe="-[0-9]{4}"),
    Rule("ssn_tax_id", EIN, 0.9, ("-",), probe="[0-9]-[0-9]{7}"),
    Rule("amount", MONEY, 0.95, ("$",)),
    Rule("amount", RATE, 0.8, ("%",)),
    Rule("date", DATE, 0.95, ("-", "/", ", "), probe="[0-9](?:-[0-9]|/[0-9]|, [0-9]{4})"),
    Rule("address", ADDRESS, 0.85, STREET_WORDS),
    Rule("email", EMAIL, 0.99, ("@",)),
    Rule("phone", PHONE, 0.95, ("-", "."), probe="[0-9]{3}[.-][0-9]{4}"),
    Rule("credit_score", CREDIT_SCORE, 0.9, ("Score", "FICO"), 1),
    Rule("property", PROPERTY, 0.85, ("Property", "Collateral"), 1),
)

PII_RULES: tuple[PiiRule, ...] = _in_lines(
    PiiRule("person", PERSON, 0.85, LABEL_NEEDS, 1, strategy="REDACT"),
    PiiRule("ssn", SSN, 0.98, ("-",), probe="-[0-9]{4}", strategy="MASK"),
    PiiRule("tax_id", EIN, 0.9, ("-",), probe="[0-9]-[0-9]{7}", strategy="MASK"),
    PiiRule("account_number", ACCOUNT, 0.95, ("Number", "No.", " ID"), 1, strategy="MASK"),
    PiiRule("routing_number", ROUTING, 0.95, ("Routing", "ABA"), 1, strategy="MASK"),
    PiiRule("drivers_license", LICENSE, 0.95, ("License",), 1, strategy="REDACT"),
    PiiRule("email", EMAIL, 0.99, ("@",), 0, strategy="REDACT"),
    PiiRule("phone", PHONE, 0.95, ("-", "."), probe="[0-9]{3}[.-][0-9]{4}", strategy="MASK"),
    PiiRule("address", ADDRESS, 0.85, STREET_WORDS, 0, strategy="GENERALIZE"),
    PiiRule("date_of_birth", BIRTH, 0.95, ("Birth", "DOB"), 1, strategy="GENERALIZE"),
    PiiRule("salary_income", INCOME, 0.9, ("Income", "Salary", "Compensation"), 1, strategy="GENERALIZE"),
    PiiRule("credit_score", CREDIT_SCORE, 0.9, ("Score", "FICO"), 1, strategy="REDACT"),
    PiiRule("financial_account_details", BALANCE, 0.85, ("Balance",), 1, strategy="GENERALIZE"),
)


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lines_sql(text: str) -> str:
    """The lines of the text column."""
    return f"split({text}, '\\n')"


def matches_sql(text: str, rule: Rule, lines: str | None = None) -> str:
    """All values of one rule in the text column, in text order; ``lines`` is SQL of its lines."""
    none = "CAST(array() AS array<string>)"

    def held(part: str) -> str:
        return " OR ".join(f"contains({part}, {sql_text(need)})" for need in rule.needs)

    def found(part: str) -> str:
        return f"regexp_extract_all({part}, {sql_text(rule.pattern)}, {rule.group})"

    if rule.one_line and rule.needs:
        def some(test: str) -> str:
            return f"flatten(transform(filter({lines or lines_sql(text)}, l -> {test}), l -> {found('l')}))"

        if len(rule.needs) < 3:
            return f"CASE WHEN {held(text)} THEN {some(held('l'))} ELSE {none} END"
        # most of many needs are nowhere in a text: its lines are asked for the others
        met = f"filter(array({', '.join(map(sql_text, rule.needs))}), need -> contains({text}, need))"
        in_lines = some("exists(met, need -> contains(l, need))")
        return f"get(transform(array({met}), met -> CASE WHEN size(met) > 0 THEN {in_lines} ELSE {none} END), 0)"
    tests = [held(text)] if rule.needs else []
    if rule.probe:
        tests.append(f"regexp_like({text}, {sql_text(rule.probe)})")
    if not tests:
        return found(text)
    return f"CASE WHEN {' AND '.join(f'({t})' for t in tests)} THEN {found(text)} ELSE {none} END"


def _key(rule: Rule) -> tuple:
    return (rule.pattern, rule.group, rule.needs, rule.probe, rule.one_line)


class SharedMatches:
    """Matches of two rule sets with each distinct pattern searched once.

    ``columns`` gives one expression per pattern, to be added to the rows; Catalyst
    drops those that nothing reads. ``sql`` is what stands for a rule's matches then.
    """

    def __init__(self, first: Iterable[Rule], second: Iterable[Rule], prefix: str = "_match"):
        first, second = list(first), list(second)
        keys = dict.fromkeys(_key(r) for r in [*second, *first])
        self.names = {key: f"{prefix}{i}" for i, key in enumerate(keys)}
        in_second = {_key(r) for r in second}
        self.rules = {_key(r): (r, _key(r) in in_second) for r in [*first, *second]}

    def columns(self, first: tuple[str, str], second: tuple[str, str]) -> dict[str, Column]:
        """Patterns only the first set has read the first text, all others the second; each text
        comes with the column of its lines."""
        return {
            self.names[key]: F.expr(matches_sql(text, rule, lines))
            for key, (rule, shared) in self.rules.items()
            for text, lines in [second if shared else first]
        }

    def sql(self, text: str, rule: Rule) -> str:
        return self.names[_key(rule)]


#: the lines of a text, split once for all rules
_LINES = "_lines"


def _in_shared_lines(text: str, rule: Rule) -> str:
    return matches_sql(text, rule, _LINES)


def _items(text: str, rules: Iterable[Rule], item, data_type: str, search) -> Column:
    """Items rule by rule, in text order within a rule; none for a NULL text.

    The expression is handed over as text: it has hundreds of nodes, and building it
    call by call would take longer than planning it.
    """
    parts = [f"transform({search(text, rule)}, v -> {item(rule)})" for rule in rules]
    empty = f"CAST(array() AS {data_type})"
    if not parts:
        return F.expr(empty)
    found = f"concat({', '.join(parts)})"
    if search is _in_shared_lines:
        found = f"get(transform(array({lines_sql(text)}), {_LINES} -> {found}), 0)"
    return F.expr(f"CASE WHEN {text} IS NULL THEN {empty} ELSE {found} END")


def entities_of(text: str, rules: Iterable[Rule], search=_in_shared_lines) -> Column:
    """Typed entities of the text column ``text``."""

    def item(rule: Rule) -> str:
        return f"named_struct('type', {sql_text(rule.type)}, 'value', v, 'confidence', CAST({rule.confidence} AS double))"

    return _items(text, rules, item, f"array<{ddl(ENTITY)}>", search)


def pii_items_of(text: str, rules: Iterable[PiiRule], search=_in_shared_lines) -> Column:
    """Personal data of the text column ``text`` with strategy and replacement."""

    def item(rule: PiiRule) -> str:
        return (
            f"named_struct('type', {sql_text(rule.type)}, 'value', v, 'strategy', {sql_text(rule.strategy)}, "
            f"'replacement', {replacement_sql(rule.type, rule.strategy, 'v')})"
        )

    return _items(text, rules, item, f"array<{ddl(PII_ITEM)}>", search)


@dataclass(frozen=True)
class Lexicon:
    """Weighted single-word terms per category, small enough to live in a plan."""

    terms: tuple[tuple[str, str, float], ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        # lower case, and each term once in a category, at its highest weight
        best: dict[tuple[str, str], float] = {}
        for category, term, weight in self.terms:
            key = (category, term.lower())
            best[key] = max(weight, best.get(key, weight))
        object.__setattr__(self, "terms", tuple((c, t, w) for (c, t), w in best.items()))

    @classmethod
    def of(cls, groups: dict[str, str | Iterable[str]], weight: float = 1.0) -> "Lexicon":
        rows = []
        for category, words in groups.items():
            for word in words.split() if isinstance(words, str) else words:
                rows.append((category, word.lower(), float(weight)))
        return cls(tuple(rows))

    def __len__(self) -> int:
        return len(self.terms)

    def categories(self) -> list[str]:
        return sorted({category for category, _, _ in self.terms})

    def words(self) -> list[str]:
        return sorted({term for _, term, _ in self.terms})

    def by_weight(self, category: str) -> dict[float, list[str]]:
        groups: dict[float, list[str]] = {}
        for cat, term, weight in self.terms:
            if cat == category:
                groups.setdefault(weight, []).append(term)
        return groups


DEFAULT_LEXICON = Lexicon.of(
    dict(
        zip(
            CATEGORIES,
            (
                "loan mortgage borrower lender application principal escrow amortization residential",
                "assets liabilities equity revenue expenses income profit loss cash",
                "portfolio investment investor fund stocks bonds securities prospectus shares advisor",
                "credit score bureau inquiries delinquent tradeline fico history",
                "statement deposits withdrawals balance checking savings transactions purchases payments routing",
                "tax taxable irs return withholding deduction refund assessment",
                "insurance policy insured premium coverage beneficiary beneficiaries benefit claim death",
                "compliance regulatory audit filing kyc risk sanctions disclosure",
                "agreement contract party parties terms obligations governing termination",
            ),
        )
    )
)
