"""Functions of logits, features and signals as Spark SQL text over ``array<double>`` (J)."""

from __future__ import annotations

from bitcurve.functions.bd import let_sql

FLOOR = "1e-12D"


def total(values: str) -> str:
    return f"aggregate({values}, 0D, (s, x) -> s + x)"


def dot(a: str, b: str) -> str:
    return total(f"zip_with({a}, {b}, (x, y) -> x*y)")


def softmax(logits: str) -> str:
    shifted = let_sql("mx", f"array_max({logits})", f"transform({logits}, x -> exp(x - mx))")
    return let_sql("ex", shifted, let_sql("sm", total("ex"), "transform(ex, x -> x/sm)"))


def log_softmax(logits: str) -> str:
    inner = f"aggregate({logits}, 0D, (s, x) -> s + exp(x - mx))"
    return let_sql("mx", f"array_max({logits})", let_sql("lz", f"mx + ln({inner})", f"transform({logits}, x -> x - lz)"))


def argmax(values: str) -> str:
    """0-based position of the (first) largest value."""
    return f"int(array_position({values}, array_max({values})) - 1)"


def top2(probabilities: str) -> str:
    """struct<confidence, margin> of the two largest probabilities."""
    return let_sql(
        "so", f"sort_array({probabilities}, false)", "named_struct('confidence', so[0], 'margin', so[0] - so[1])"
    )


def entropy(probabilities: str) -> str:
    return "(-" + total(f"transform({probabilities}, p -> p*ln(greatest(p, {FLOOR})))") + ")"


def kl(source_probabilities: str, candidate_log: str) -> str:
    """KL divergence of the candidate from the source; zero source terms count zero."""
    term = f"zip_with({source_probabilities}, {candidate_log}, (p, l) -> CASE WHEN p > 0 THEN p*(ln(p) - l) ELSE 0D END)"
    return total(term)


def cosine_distance(a: str, b: str) -> str:
    return f"(1 - {dot(a, b)}/greatest(sqrt({dot(a, a)})*sqrt({dot(b, b)}), 1e-8D))"


def agrees(a: str, b: str) -> str:
    return f"({argmax(a)} = {argmax(b)})"


def source_class_probability(candidate: str, source: str) -> str:
    return f"get({candidate}, {argmax(source)})"


def cross_entropy(logits: str, target: str) -> str:
    return f"(-get({log_softmax(logits)}, {target}))"


def derivative(values: str) -> str:
    """Differences of neighbours."""
    n = f"size({values})"
    return f"zip_with(slice({values}, 2, {n} - 1), slice({values}, 1, {n} - 1), (x, y) -> x - y)"


def second_derivative(values: str) -> str:
    return derivative(derivative(values))


def mean_square(values: str) -> str:
    return f"({dot(values, values)}/size({values}))"


def difference_energy(a: str, b: str, derivatives) -> str:
    """Normalised energy of the difference of several derivatives, averaged and capped at 2."""
    parts = []
    for derive in derivatives:
        da, db = derive(a), derive(b)
        gap = mean_square(f"zip_with({da}, {db}, (x, y) -> x - y)")
        parts.append(f"{gap}/({mean_square(da)} + {mean_square(db)} + {FLOOR})")
    return f"least(2D, ({' + '.join(parts)})/{len(parts)})"


def relative_l1(a: str, b: str, floor: str = "1D") -> str:
    """Mean absolute difference over the mean size of ``a`` (at least ``floor``), capped at 2."""
    gap = total(f"zip_with({a}, {b}, (x, y) -> abs(x - y))") + f"/size({a})"
    size = total(f"transform({a}, x -> abs(x))") + f"/size({a})"
    return f"least(2D, greatest(0D, ({gap})/greatest({size}, {floor})))"


def worst_relative_l1(a: str, b: str, derivatives, floor: str = "1D") -> str:
    return "greatest(" + ", ".join(relative_l1(d(a), d(b), floor) for d in derivatives) + ")"


def unit_distance(a: str, b: str) -> str:
    """Half the squared distance of the two vectors scaled to unit length."""
    na, nb = f"greatest(sqrt({dot(a, a)}), {FLOOR})", f"greatest(sqrt({dot(b, b)}), {FLOOR})"
    body = total("zip_with(a_, b_, (x, y) -> (x - y)*(x - y))") + "/2"
    return let_sql(
        "a_", let_sql("n_", na, f"transform({a}, x -> x/n_)"), let_sql("b_", let_sql("n_", nb, f"transform({b}, x -> x/n_)"), body)
    )
