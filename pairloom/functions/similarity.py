"""Similarity of name tokens as Column expressions, so no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of token equivalence.
JARO_WINKLER_LEAST = 0.92
EDITS_MOST = 1
PREFIX_LEAST = 4

#: A name with its short forms; two tokens in one group are equivalent, which is not transitive.
NICKNAMES = {
    "ALEJANDRO": ["ALEX", "JANDRO"], "ANTHONY": ["TONY"], "ANTONIO": ["TONO", "TONY"], "CHARLES": ["CHARLIE", "CHUCK", "CHAS"],
    "CHRISTOPHER": ["CHRIS", "TOPHER"], "CONCEPCION": ["CONCHA", "CONCHITA"], "DANIEL": ["DAN", "DANNY"], "DAVID": ["DAVE", "DAVEY"],
    "DOLORES": ["LOLA", "LOLITA"], "EDUARDO": ["LALO", "EDDIE"], "ELIZABETH": ["BETH", "LIZ", "LIZZIE", "BETTY", "ELIZA"],
    "FRANCISCO": ["PACO", "PANCHO", "FRANK"], "GUADALUPE": ["LUPE", "LUPITA"], "IGNACIO": ["NACHO"], "JAMES": ["JIM", "JIMMY", "JAMIE"],
    "JENNIFER": ["JEN", "JENNY", "JENNIE"], "JESSICA": ["JESS", "JESSIE"], "JESUS": ["CHUY", "CHUS"], "JOSE": ["PEPE", "CHE"],
    "JOSEPH": ["JOE", "JOEY"], "KATHERINE": ["KATE", "KATIE", "KATHY", "KAT"], "MANUEL": ["MANNY", "MELO", "LOLO"],
    "MARGARET": ["MAGGIE", "PEGGY", "MARGE"], "MARIA": ["MARI", "MIA"], "MATTHEW": ["MATT"], "MERCEDES": ["MECHE"],
    "MICHAEL": ["MIKE", "MICKEY", "MICK"], "PATRICIA": ["PAT", "PATTY", "TRICIA"], "REFUGIO": ["CUCO"],
    "RICHARD": ["RICK", "DICK", "RICH", "RICKY"], "ROBERT": ["BOB", "ROB", "BOBBY", "ROBBIE"], "ROBERTO": ["BETO", "ROB"],
    "ROSA": ["ROSITA", "ROSIE"], "ROSARIO": ["CHARO", "CHAYO"], "STEPHANIE": ["STEPH"], "TERESA": ["TERE", "TERRY"],
    "THOMAS": ["TOM", "TOMMY"], "WILLIAM": ["BILL", "WILL", "BILLY", "WILLIE"],
}


def nickname_groups() -> dict[str, list[int]]:
    """Each form with the numbers of its groups."""
    out: dict[str, list[int]] = {}
    for k, (name, forms) in enumerate(NICKNAMES.items()):
        for form in [name, *forms]:
            out.setdefault(form, []).append(k)
    return out


def _group_map() -> Column:
    groups = nickname_groups()
    return F.create_map(*[x for form, ks in groups.items() for x in (F.lit(form), F.array(*[F.lit(k) for k in ks]))])


def nickname_equal(a: Column, b: Column) -> Column:
    m = _group_map()
    return F.coalesce(F.arrays_overlap(F.try_element_at(m, a), F.try_element_at(m, b)), F.lit(False))


def one_edit(a: Column, b: Column) -> Column:
    """Edit distance of one at most, where an adjacent swap is one edit."""
    n = F.length(a)
    edits = F.levenshtein(a, b, EDITS_MOST + 1)
    swapped = F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, n)) == b)
    # a swap is two plain edits, so only such pairs of one length are looked at letter by letter
    return F.when(edits == 2, (n == F.length(b)) & (n > 1) & swapped).otherwise(edits >= 0)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity: four characters of common prefix at most, and only above 0.7.

    The other text's matched characters are overwritten as they are used, so a fold over
    the characters of ``a`` holds the whole state in two strings.
    """
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))
    used = F.lit("\u0001")

    def step(acc: Column, i: Column) -> Column:
        low = F.greatest(i - reach, F.lit(1))
        high = F.least(i + reach, lb)
        at = F.when(high >= low, F.instr(acc["b"].substr(low, high - low + 1), a.substr(i, F.lit(1)))).otherwise(F.lit(0))
        place = low + at - 1
        return F.when(at > 0, F.struct(F.concat(acc["b"].substr(F.lit(1), place - 1), used, acc["b"].substr(place + 1, lb)).alias("b"), F.concat(acc["m"], a.substr(i, F.lit(1))).alias("m"))).otherwise(acc)

    def score(acc: Column) -> Column:
        m = F.length(acc["m"])
        other = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), lb), lambda j: acc["b"].substr(j, F.lit(1)) == used), lambda j: b.substr(j, F.lit(1))), "")
        off = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0), lambda n, k: n + F.when(acc["m"].substr(k, F.lit(1)) != other.substr(k, F.lit(1)), 1).otherwise(0))
        t = F.floor(off / 2)
        jaro = (m / la + m / lb + (m - t) / F.greatest(m, F.lit(1))) / 3
        shared = F.lit(0)
        for k in (4, 3, 2, 1):
            shared = F.when(shared > 0, shared).when((la >= k) & (lb >= k) & (a.substr(1, k) == b.substr(1, k)), k).otherwise(0)
        return F.when(m == 0, F.lit(0.0)).when(jaro > 0.7, jaro + shared * 0.1 * (1 - jaro)).otherwise(jaro)

    start = F.struct(b.alias("b"), F.lit("").alias("m"))
    return F.when((la == 0) | (lb == 0), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), la), start, step, score))


def _may_be_close(a: Column, b: Column) -> Column:
    """False where Jaro-Winkler can't reach the threshold: no more letters match than occur in the other token."""
    la, lb = F.length(a), F.length(b)
    m = F.least(la - F.length(F.call_function("translate", a, b, F.lit(""))), lb - F.length(F.call_function("translate", b, a, F.lit(""))))
    best = (m / la + m / lb + 1) / 3
    prefix = F.when(a.substr(1, 4) == b.substr(1, 4), 0.4).when(a.substr(1, 3) == b.substr(1, 3), 0.3).when(a.substr(1, 2) == b.substr(1, 2), 0.2).when(a.substr(1, 1) == b.substr(1, 1), 0.1).otherwise(0.0)
    return best + prefix * (1 - best) >= JARO_WINKLER_LEAST - 1e-9


def tokens_equal(a: Column, b: Column) -> Column:
    """Two tokens may be one name: equal, nickname, initial, beginning, or a typo of a longer token."""
    la, lb = F.length(a), F.length(b)
    initial = ((la == 1) & b.startswith(a)) | ((lb == 1) & a.startswith(b))
    beginning = ((la <= lb) & (la >= PREFIX_LEAST) & b.startswith(a)) | ((lb <= la) & (lb >= PREFIX_LEAST) & a.startswith(b))
    long = F.greatest(la, lb) >= 4
    return (
        F.when(a == b, True).when(initial | beginning, True).when(nickname_equal(a, b), True)
        .when(long & one_edit(a, b), True).when(long & _may_be_close(a, b), jaro_winkler(a, b) >= JARO_WINKLER_LEAST).otherwise(False)
    )


def near_tokens(pairs: DataFrame) -> DataFrame:
    """(token, near): with which other tokens each is equivalent; ``pairs`` has distinct tokens t and u.

    A name token stands in very many pairs of records, and is compared here once for each
    other token that it meets.
    """
    same = pairs.where("t != u").where(tokens_equal(F.col("t"), F.col("u"))).select("t", "u")
    both = same.unionAll(same.select(F.col("u").alias("t"), F.col("t").alias("u")))
    return both.groupBy(F.col("t").alias("token")).agg(F.collect_set("u").alias("near"))


def greedy_matches(small: Column, large: Column) -> Column:
    """How many tokens (structs of a token t and its ``near`` ones) of ``small`` find an equivalent in what is left of ``large``, first come, first served."""

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc["rest"], lambda u: (u == x["t"]) | F.array_contains(x["near"], u)), True).cast("int")
        rest = F.filter(acc["rest"], lambda u, j: j != at - 1)
        return F.when(at > 0, F.struct(rest.alias("rest"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    start = F.struct(F.transform(large, lambda y: y["t"]).alias("rest"), F.lit(0).alias("n"))
    return F.aggregate(small, start, step, lambda acc: acc["n"])
