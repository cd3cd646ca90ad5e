"""First-order formulas as columns: tokens, literals, operator order and truth tables on 64-bit masks.

The expressions nest lambdas deeply, so they are written as SQL text. ``let`` names an intermediate value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formula alphabet, the size budget, the dummy name and the matching limits.
BINARY = "⊕∨∧→↔"
SYMBOLS = "⊕∨∧→↔∀∃¬(),"
MAX_CHARS = 180
MAX_CONJUNCTIONS = 5
MAX_DISJUNCTIONS = 5
DUMMY = "#DUMMY_"
DUMMY_DISTANCE = 10000
SIMILARITY_FLOOR = 0.6

_NAME = rf"[^{SYMBOLS}\s]+"
_LITERAL = rf"{_NAME} \( {_NAME}(?: , {_NAME})* \)"

# Codes of the operators in postfix order are -1, -2, ... by their place here. Binding strength is a design decision,
# since the data's grammar leaves it open: negation, conjunction, (exclusive) disjunction, implication (to the right),
# equivalence.
_OPERATORS = "¬∧∨⊕→↔"
_STRENGTHS = "array(5, 4, 3, 3, 2, 1)"
_NOT, _AND, _OR, _XOR, _IMPLIES = -1, -2, -3, -4, -5
_OPEN, _CLOSE, _STRAY = -7, -8, -9
# Values inside partly evaluated formulas.
_TRUE, _FALSE = -10, -11

# Column j of a truth table over six variables, one bit per assignment.
_MASKS = (
    -6148914691236517206,
    -3689348814741910324,
    -1085102592571150096,
    -71777214294589696,
    -281470681808896,
    -4294967296,
)


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _raw_tokens(c: str) -> str:
    spaced = f"regexp_replace({c}, r'([{SYMBOLS}])', ' $1 ')"
    bare = rf"transform(split({spaced}, r'(?U)\s+'), t -> replace(t, '\'', ''))"
    return f"filter({bare}, t -> t <> '')"


def _merged(c: str) -> str:
    """Blank-separated tokens; words of two or more characters get brackets, and adjoining brackets vanish."""
    bracketed = (
        f"transform({_raw_tokens(c)}, t -> CASE WHEN length(t) > 1 "
        "THEN concat('\u0001', upper(substring(t, 1, 1)), substring(t, 2), '\u0002') ELSE t END)"
    )
    return f"translate(replace(array_join({bracketed}, ' '), '\u0002 \u0001', ''), '\u0001\u0002', '')"


def tokens(c: str) -> Column:
    """Tokens in which a run of words such as ``dc universe`` is one name, ``DcUniverse``."""
    return F.expr(f"filter(split({_merged(c)}, ' '), t -> t <> '')")


def normalized(c: str) -> Column:
    """The formula with uniform spacing."""
    spelled = rf"""array_join(transform(parts, (t, i) -> CASE
        WHEN length(t) = 1 AND contains('{BINARY}', t) THEN concat(' ', t, ' ')
        WHEN t = ',' THEN ', '
        WHEN t RLIKE r'(?U)^\w$' AND coalesce(get(parts, i - 1) IN ('∀', '∃'), false) THEN concat(t, ' ')
        ELSE t END), '')"""
    return F.expr(_let(_raw_tokens(c), "parts", spelled))


def hoisted(c: str) -> Column:
    """All ``∀v`` / ``∃v`` at the front, in their order; each match removes its first occurrence."""
    found = rf"reverse(regexp_extract_all({c}, r'(?U)([∃∀]\w)', 1))"
    moved = (
        "concat(m, ' ', substring(acc, 1, instr(acc, m) - 1), substring(acc, instr(acc, m) + length(m)))"
    )
    return F.expr(f"aggregate({found}, {c}, (acc, m) -> {moved})")


def _units(c: str) -> str:
    """Literals, connectives and parentheses, without quantifiers, which truth tables ignore."""
    matrix = rf"regexp_replace(concat({_merged(c)}, ' '), r'[∀∃] {_NAME} ', '')"
    return rf"transform(regexp_extract_all({matrix}, r'({_LITERAL}|\S+)', 1), t -> replace(t, ' ', ''))"


def _atoms(units: str) -> str:
    return f"array_distinct(filter({units}, t -> length(t) > 1 AND contains(t, '(')))"


def literals(c: str) -> Column:
    """Distinct predicate atoms in order of first appearance, negation stripped."""
    return F.expr(_atoms(_units(c)))


@dataclass(frozen=True)
class Budget:
    """Size limits of formulas that are worth a truth table."""

    max_chars: int = MAX_CHARS
    max_and: int = MAX_CONJUNCTIONS
    max_or: int = MAX_DISJUNCTIONS

    def allows(self, c: str) -> Column:
        return in_budget(c, self.max_chars, self.max_and, self.max_or)


def in_budget(c: str, max_chars: int = MAX_CHARS, max_and: int = MAX_CONJUNCTIONS, max_or: int = MAX_DISJUNCTIONS) -> Column:
    """Short enough, and with few enough connectives, to be worth a truth table."""
    return (
        (F.length(c) <= max_chars)
        & (F.regexp_count(c, F.lit("∧")) <= max_and)
        & (F.regexp_count(c, F.lit("∨")) <= max_or)
    )


def _well_formed(codes: str) -> str:
    """Balanced parentheses, and no two operands in a row, operator without operand or stray unit."""
    letters = f"transform({codes}, t -> CASE WHEN t >= 0 THEN 'L' ELSE substring('nooooo()x', -t, 1) END)"
    shape = f"concat('^', array_join({letters}, ''), '$')"
    depth = (
        f"aggregate({codes}, 0, (d, t) -> CASE WHEN d < 0 THEN d WHEN t = {_OPEN} THEN d + 1 "
        f"WHEN t = {_CLOSE} THEN d - 1 ELSE d END)"
    )
    return rf"NOT ({shape} RLIKE r'[L)][Ln(]|[\^o(n][o)$]|nn|x') AND {depth} = 0"


def parsed(c: str) -> Column:
    """``struct(lits, ord)``: literals, and the evaluation order or NULL when the formula is not well formed.

    The order consists of literal numbers (>= 0) and negative operator codes. A pair of parentheses only lifts the
    strength of the operators inside it. With that the pending operators stay sorted by strength, and an arriving
    operator releases exactly those that bind at least as tightly. A pending entry is 64 * depth + 8 * strength + code.
    """
    codes = f"""transform(units, t -> CASE
        WHEN array_position(atoms, t) > 0 THEN int(array_position(atoms, t)) - 1
        WHEN length(t) = 1 AND contains('{_OPERATORS}()', t) THEN -instr('{_OPERATORS}()', t)
        ELSE {_STRAY} END)"""
    state = "named_struct('depth', {0}, 'out', {1}, 'pending', {2})".format
    empty = "cast(array() AS array<int>)"
    entry = f"(64 * acc.depth + 8 * element_at({_STRENGTHS}, -t) - t)"
    # An equally strong implication waits, so that implications group to the right.
    limit = f"(64 * acc.depth + 8 * (element_at({_STRENGTHS}, -t) + int(t = {_IMPLIES})))"
    freed = f"transform(reverse(filter(acc.pending, e -> e >= {limit})), e -> -(e % 8))"
    held = f"filter(acc.pending, e -> e < {limit})"
    step = f"""CASE
        WHEN t >= 0 THEN {state('acc.depth', 'concat(acc.out, array(t))', 'acc.pending')}
        WHEN t = {_OPEN} THEN {state('acc.depth + 1', 'acc.out', 'acc.pending')}
        WHEN t = {_CLOSE} THEN {state('acc.depth - 1', 'acc.out', 'acc.pending')}
        WHEN t = {_NOT} THEN {state('acc.depth', 'acc.out', f'concat(acc.pending, array({entry}))')}
        ELSE {state('acc.depth', f'concat(acc.out, {freed})', f'concat({held}, array({entry}))')} END"""
    ordered = (
        f"aggregate(codes, {state('0', empty, empty)}, (acc, t) -> {step}, "
        "acc -> concat(acc.out, transform(reverse(acc.pending), e -> -(e % 8))))"
    )
    guarded = f"CASE WHEN {_well_formed('codes')} THEN {ordered} END"
    result = f"named_struct('lits', atoms, 'ord', {_let(codes, 'codes', guarded)})"
    return F.expr(_let(_units(c), "units", _let(_atoms("units"), "atoms", result)))


def postfix(c: str) -> Column:
    """The evaluation order alone."""
    return parsed(c)["ord"]


def _truth_mask(order: str, variables: str) -> str:
    """Value of a postfix formula; ``masks`` holds the variables' columns of the truth table."""
    a, b = "element_at(stack, -2)", "element_at(stack, -1)"
    joined = (
        f"CASE t WHEN {_AND} THEN {a} & {b} WHEN {_OR} THEN {a} | {b} WHEN {_XOR} THEN {a} ^ {b} "
        f"WHEN {_IMPLIES} THEN ~{a} | {b} ELSE ~({a} ^ {b}) END"
    )
    return f"""aggregate({order}, cast(array() AS array<bigint>), (stack, t) -> CASE
        WHEN t >= 0 THEN concat(stack, array(masks[{variables}[t]]))
        WHEN t = {_NOT} THEN concat(slice(stack, 1, size(stack) - 1), array(~{b}))
        ELSE concat(slice(stack, 1, size(stack) - 2), array({joined})) END, stack -> stack[0])"""


def _joined_chance(a: str, b: str) -> str:
    """Probability of a connective between independent parts."""
    return (
        f"CASE t WHEN {_AND} THEN {a} * {b} WHEN {_OR} THEN {a} + {b} - {a} * {b} WHEN {_XOR} THEN {a} + {b} - 2D * {a} * {b} "
        f"WHEN {_IMPLIES} THEN 1D - {a} + {a} * {b} ELSE 1D - {a} - {b} + 2D * {a} * {b} END"
    )


def conditional_agreement(order_a: str, vars_a: str, order_b: str, vars_b: str, repeated: str, first: str, last: str) -> Column:
    """Summed over assignments ``first``..``last`` of the ``repeated`` variables: the share of all others on which two
    formulas agree.

    Every other variable occurs once, in one of the formulas. Given the repeated ones, the two sides of each connective
    are then independent, so the probability of a formula follows from those of its parts, exactly.
    """

    def chance(order: str, variables: str) -> str:
        a, b = "element_at(stack, -2)", "element_at(stack, -1)"
        joined = _joined_chance(a, b)
        place = f"array_position({repeated}, {variables}[t])"
        leaf = f"CASE WHEN {place} > 0 THEN double(getbit(assignment, int({place} - 1))) ELSE 0.5D END"
        return f"""aggregate({order}, cast(array() AS array<double>), (stack, t) -> CASE
            WHEN t >= 0 THEN concat(stack, array({leaf}))
            WHEN t = {_NOT} THEN concat(slice(stack, 1, size(stack) - 1), array(1D - {b}))
            ELSE concat(slice(stack, 1, size(stack) - 2), array({joined})) END, stack -> stack[0])"""

    both = f"transform(array(named_struct('a', {chance(order_a, vars_a)}, 'b', {chance(order_b, vars_b)})), c -> c.a * c.b + (1D - c.a) * (1D - c.b))[0]"
    return F.expr(f"aggregate(sequence({first}, {last}), 0D, (total, assignment) -> total + {both})")


def _restricted(formula: str, variable: str, value: int) -> str:
    """What is left of a postfix formula over variables once one of them is known; parts that are settled vanish."""
    a, b = "element_at(stack, -2)", "element_at(stack, -1)"
    true, false = f"array({_TRUE})", f"array({_FALSE})"

    def negated(x: str) -> str:
        return (
            f"CASE WHEN {x} = {true} THEN {false} WHEN {x} = {false} THEN {true} "
            f"WHEN element_at({x}, -1) = {_NOT} THEN slice({x}, 1, size({x}) - 1) ELSE concat({x}, array({_NOT})) END"
        )

    joined = f"""CASE
        WHEN {a} = {b} THEN CASE WHEN t IN ({_AND}, {_OR}) THEN {a} WHEN t = {_XOR} THEN {false} ELSE {true} END
        WHEN t = {_AND} THEN CASE WHEN {a} = {false} OR {b} = {false} THEN {false} WHEN {a} = {true} THEN {b} WHEN {b} = {true} THEN {a} ELSE concat({a}, {b}, array(t)) END
        WHEN t = {_OR} THEN CASE WHEN {a} = {true} OR {b} = {true} THEN {true} WHEN {a} = {false} THEN {b} WHEN {b} = {false} THEN {a} ELSE concat({a}, {b}, array(t)) END
        WHEN t = {_IMPLIES} THEN CASE WHEN {a} = {false} OR {b} = {true} THEN {true} WHEN {a} = {true} THEN {b} WHEN {b} = {false} THEN {negated(a)} ELSE concat({a}, {b}, array(t)) END
        WHEN {a} = IF(t = {_XOR}, {false}, {true}) THEN {b} WHEN {b} = IF(t = {_XOR}, {false}, {true}) THEN {a}
        WHEN {a} = IF(t = {_XOR}, {true}, {false}) THEN {negated(b)} WHEN {b} = IF(t = {_XOR}, {true}, {false}) THEN {negated(a)}
        ELSE concat({a}, {b}, array(t)) END"""
    return f"""aggregate({formula}, cast(array() AS array<array<int>>), (stack, t) -> CASE
        WHEN t = {variable} THEN concat(stack, array(array({value})))
        WHEN t >= 0 OR t <= {_TRUE} THEN concat(stack, array(array(t)))
        WHEN t = {_NOT} THEN concat(slice(stack, 1, size(stack) - 1), array({negated(b)}))
        ELSE concat(slice(stack, 1, size(stack) - 2), array({joined})) END, stack -> stack[0])"""


def diagram_agreement(order_a: str, vars_a: str, order_b: str, vars_b: str, repeated: str, width: int) -> Column:
    """The share of all assignments on which two formulas agree, by a decision diagram that is built layer by layer.

    A node is what is left of both formulas once the ``repeated`` variables so far are known, and weighs as much as the
    assignments that lead to it; equal ones are one node. Where the formulas have become equal, nothing else of them
    matters. Variables that occur once are left to the end, where they are independent. NULL if a layer has more than
    ``width`` nodes.
    """
    over = lambda order, names: f"transform({order}, t -> CASE WHEN t >= 0 THEN {names}[t] ELSE t END)"
    node = lambda a, b, weight: f"named_struct('a', {a}, 'b', {b}, 'w', {weight})"
    settled = lambda a, b, weight: _let(
        node(a, b, weight), "n", f"IF(n.a = n.b, {node(f'array({_TRUE})', f'array({_TRUE})', 'n.w')}, n)"
    )
    half = lambda value: settled(_restricted("s.a", "v", value), _restricted("s.b", "v", value), "s.w / 2D")
    split = f"flatten(transform(layer, s -> array({half(_TRUE)}, {half(_FALSE)})))"
    empty = "cast(array() AS array<struct<a: array<int>, b: array<int>, w: double>>)"
    last = "element_at(nodes, -1)"
    merged = f"""aggregate(array_sort({split}), {empty}, (nodes, s) -> CASE
        WHEN size(nodes) > 0 THEN CASE WHEN {last}.a = s.a AND {last}.b = s.b
            THEN concat(slice(nodes, 1, size(nodes) - 1), array({node('s.a', 's.b', f'{last}.w + s.w')})) ELSE concat(nodes, array(s)) END
        ELSE array(s) END)"""
    layers = f"""aggregate({repeated}, array({node(over(order_a, vars_a), over(order_b, vars_b), '1D')}),
        (layer, v) -> {_let(merged, 'next', f'CASE WHEN size(next) <= {width} THEN next END')})"""

    def chance(formula: str) -> str:
        a, b = "element_at(stack, -2)", "element_at(stack, -1)"
        return f"""aggregate({formula}, cast(array() AS array<double>), (stack, t) -> CASE
            WHEN t >= 0 THEN concat(stack, array(0.5D)) WHEN t = {_TRUE} THEN concat(stack, array(1D)) WHEN t = {_FALSE} THEN concat(stack, array(0D))
            WHEN t = {_NOT} THEN concat(slice(stack, 1, size(stack) - 1), array(1D - {b}))
            ELSE concat(slice(stack, 1, size(stack) - 2), array({_joined_chance(a, b)})) END, stack -> stack[0])"""

    both = _let(f"named_struct('a', {chance('n.a')}, 'b', {chance('n.b')})", "c", "c.a * c.b + (1D - c.a) * (1D - c.b)")
    return F.expr(f"aggregate({layers}, 0D, (total, n) -> total + n.w * {both})")


def agreeing_bits(order_a: str, vars_a: str, order_b: str, vars_b: str, variables: str,
                  first: str, last: str) -> Column:
    """Number of assignments in blocks ``first``..``last`` on which two formulas agree.

    A block fixes all variables from the seventh on and covers the 64 assignments of the others.
    """
    masks = f"""transform(sequence(0, {variables} - 1), v -> CASE
        WHEN v < {len(_MASKS)} THEN element_at(array({', '.join(f'{m}L' for m in _MASKS)}), v + 1)
        ELSE -bigint(getbit(block, v - {len(_MASKS)})) END)"""
    equal = f"bigint(bit_count(~({_truth_mask(order_a, vars_a)} ^ {_truth_mask(order_b, vars_b)})))"
    return F.expr(
        f"aggregate(sequence({first}, {last}), 0L, (bits, block) -> bits + {_let(masks, 'masks', equal)})"
    )
