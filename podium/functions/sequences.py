"""Column expressions on ids and letter sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the trimming rules.
N_TAGS = ("MGSSHHHHHHSSGLVPRGSH", "MGSSHHHHHHSSGLVPRGS", "MHHHHHHSSG", "MHHHHHH")
EPITOPE_TAGS = ("MGSDYKDHDGDYKDHDIDYKDDDDKLG", "MGSHHHHHHSGENLYFQG", "MGSSHHHHHHSSGENLYFQG", "MHHHHHHSSGENLYFQG")
C_TAGS = ("GSHHHHHH", "GHHHHHH", "HHHHHH")
MIN_LEFT, WINDOW, MIN_AFTER_WINDOW = 30, 40, 80
VARIABLE_ENDS = ("WGQGTMVAVSS", "WGQGTLVTVSS", "WGQGTLVSVSS", "WGQGTSVTVSS", "FGTGTKVTVL", "FGPGTTVDSK", "FGIGTKVTVL", "FGGGTKLTVL")
VARIABLE_STARTS = ("QVQL", "EVQL", "QLQL", "QVHL", "QVQLK", "QSALTQ", "EIVVTQ", "SFELTQ", "QAVVTQ", "DIQMTQ", "ELTQP", "QSVLTQ")
# fixed values: letters of nucleic and of protein sequences, and how targets are named in texts
NUCLEIC, PROTEIN = "ACGTUN", "ABCDEFGHIKLMNPQRSTVWXYZ"
TARGET_TOKEN = r"(?i)\b([THRDML]\d{4}(?:s\d+|v\d+)?)\b"


def base_target(target: Column) -> Column:
    """Upper case, without a subunit suffix; variants stay."""
    return F.regexp_replace(F.upper(F.trim(target)), r"^([A-Z]\d{4})S\d+$", "$1")


def target_of_model(model: Column) -> Column:
    """The target in a model's name: what stands before TS, else the first target id, else blank."""
    before = F.regexp_extract(model, r"(?i)\b([A-Z]\d{4}(?:v\d+)?)TS", 1)
    return F.upper(F.when(before != "", before).otherwise(F.regexp_extract(model, TARGET_TOKEN, 1)))


def group_of_model(model: Column) -> Column:
    """What stands between TS and the next _ or -."""
    return F.when(F.instr(model, "TS") == 0, "").otherwise(F.regexp_extract(model, r"TS([^_\-]*)", 1))


def aliases(target: Column) -> Column:
    """The id itself and those of the other phases (0, 1, 2 as second character)."""
    up = F.upper(target)
    phased = F.transform(F.array(F.lit("0"), F.lit("1"), F.lit("2")), lambda p: F.concat(F.substring(up, 1, 1), p, F.substring(up, 3, 100)))
    return F.when(up.rlike(r"^[THRDML][012]\d{3}(S\d+|V\d+)?$"), F.array_distinct(F.concat(F.array(up), phased))).otherwise(F.array(up))


def recovery_aliases(target: Column) -> Column:
    """Aliases in the order in which they are tried: the id, its phases, its first variant, and earlier phases of the second one."""
    up = F.upper(target)
    variant = lambda sep: F.regexp_extract(up, rf"^(.*){sep}V\d+$", 1)
    later = lambda sep: up.rlike(rf"^.*{sep}V\d+$") & ~up.rlike(rf"^.*{sep}V1$")
    tail = F.array(
        F.when(later(""), F.concat(variant(""), F.lit("V1"))),
        F.when(later("_"), F.concat(variant("_"), F.lit("_V1"))),
        F.when(up.rlike(r"^.*_V\d+$"), variant("_")),
        *(F.when(up.rlike(r"^[TH]2\d{3}"), F.concat(F.substring(up, 1, 1), F.lit(p), F.substr(up, F.lit(3)))) for p in "10"),
    )
    # most ids name neither a version nor the second phase; they are told by one test
    tail = F.when(up.rlike(r"V\d+$|^[TH]2\d{3}"), tail).otherwise(F.array().cast("array<string>"))
    phases = F.array_sort(F.array_except(aliases(target), F.array(up)))
    return F.array_distinct(F.filter(F.concat(F.array(up), phases, tail), lambda a: a.isNotNull()))


def content_kind(sequence: Column) -> Column:
    """Kind by letters alone; blank where they don't tell."""
    s = F.regexp_replace(F.upper(sequence), r"\s+", "")
    other = F.length(F.regexp_replace(s, f"[{NUCLEIC}]", ""))
    return (
        F.when(s == "", "")
        .when(s.rlike(f"^[{NUCLEIC}]+$"), F.when(F.contains(s, F.lit("U")), "rnaSequence").otherwise("dnaSequence"))
        .when(~s.rlike(f"^[{PROTEIN}]+$"), "")
        .when((F.length(s) >= 30) & (other / F.length(s) >= 0.10), "proteinChain")
        .otherwise("")
    )


def sequence_kind(record_id: Column, header: Column, sequence: Column) -> Column:
    """Protein by content first; else what the header says, then the id's first letter, then the letters."""
    low, s = F.lower(F.concat_ws(" ", record_id, header)), F.upper(sequence)
    first = F.upper(F.substring(record_id, 1, 1))
    return (
        F.when(content_kind(sequence) == "proteinChain", "proteinChain")
        .when(F.contains(low, F.lit("rna")), "rnaSequence")
        .when(F.contains(low, F.lit("dna")), "dnaSequence")
        .when(F.contains(low, F.lit("prot")), "proteinChain")
        .when(first.isin("T", "H"), "proteinChain")
        .when(first == "R", "rnaSequence")
        .when(first == "D", "dnaSequence")
        .when(s.rlike(f"^[{NUCLEIC}]*$"), F.when(F.contains(s, F.lit("U")), "rnaSequence").otherwise("dnaSequence"))
        .otherwise("proteinChain")
    )


def sanitized(kind: Column, sequence: Column, *, protein: str = "ACDEFGHIKLMNPQRSTVWYX", rna: str = "ACGUN", dna: str = "ACGTN") -> Column:
    """Illegal letters become X in proteins and go from nucleic acids, where T and U are told apart."""
    s = F.regexp_replace(F.upper(sequence), r"\s+", "")
    return (
        F.when(kind == "proteinChain", F.regexp_replace(s, f"[^{protein}]", "X"))
        .when(kind == "rnaSequence", F.regexp_replace(F.replace(s, F.lit("T"), F.lit("U")), f"[^{rna}]", ""))
        .when(kind == "dnaSequence", F.regexp_replace(F.replace(s, F.lit("U"), F.lit("T")), f"[^{dna}]", ""))
        .otherwise(s)
    )


def stoichiometry(state: Column, records: Column) -> Column:
    """Copies of each record; ones where nothing is said; null where the number of entries doesn't fit."""
    found = F.transform(F.regexp_extract_all(F.upper(F.coalesce(state, F.lit(""))), F.lit(r"[A-Z]+(\d+)"), 1), lambda x: x.cast("int"))
    ones = F.array_repeat(F.lit(1), records.cast("int"))
    return F.when(records < 1, F.array().cast("array<int>")).when(F.size(found) == 0, ones).when((F.size(found) == records) & F.forall(found, lambda c: c >= 1), found)


def trimmed(sequence: Column, *, epitopes: bool = False) -> Column:
    """struct(sequence, removed_n, removed_c, rules): the first fitting leading tag and the first fitting trailing tag go."""

    def cut(s: Column, tags, head: bool) -> Column:
        fits = lambda t: (F.startswith(s, F.lit(t)) if head else F.endswith(s, F.lit(t))) & (F.length(s) - len(t) >= MIN_LEFT)
        return reduce(lambda w, t: w.when(fits(t), F.lit(t)), tags[1:], F.when(fits(tags[0]), F.lit(tags[0]))).otherwise(F.lit(""))

    def tail(s: Column) -> Column:
        tag = cut(s, C_TAGS, False)
        return F.struct(F.substr(s, F.lit(1), F.length(s) - F.length(tag)).alias("sequence"), tag.alias("tag"))

    head = cut(sequence, (*EPITOPE_TAGS, *N_TAGS) if epitopes else N_TAGS, True)
    rest = tail(F.substr(sequence, F.length(head) + 1))
    rule = lambda side, tag: F.when(tag != "", F.array(F.concat(F.lit(f"trim_{side}:"), tag))).otherwise(F.array().cast("array<string>"))
    return F.struct(rest["sequence"].alias("sequence"), F.length(head).alias("removed_n"), F.length(rest["tag"]).alias("removed_c"), F.concat(rule("n", head), rule("c", rest["tag"])).alias("rules"))


def share(sequence: Column, letters: str) -> Column:
    return (F.length(sequence) - F.length(F.regexp_replace(sequence, f"[{letters}]", ""))) / F.length(sequence)


def longest_run(sequence: Column, letters: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(sequence, F.lit(f"([{letters}]+)"), 1), lambda r: F.length(r))), F.lit(0))


def entropy(sequence: Column) -> Column:
    """Shannon entropy of the letters, in bits."""
    n = F.length(sequence)
    letters = F.array_sort(F.array_distinct(F.filter(F.split(sequence, ""), lambda c: c != "")))
    p = lambda c: (n - F.length(F.replace(sequence, c, F.lit("")))) / n
    return F.aggregate(F.transform(letters, lambda c: -p(c) * F.log2(p(c))), F.lit(0.0), lambda a, x: a + x)


def low_complexity(segment: Column) -> Column:
    # fixed values: bounds and letters that tell a linker or a disordered end
    return (segment != "") & ((entropy(segment) < 3.0) | (share(segment, "GSPQKENR") >= 0.70) | (share(segment, "GS") >= 0.45))


def low_complexity_cuts(sequence: Column) -> Column:
    """struct(n, c): letters to cut at either end, a window each, if enough remain."""
    head = F.when((F.length(sequence) - WINDOW >= MIN_AFTER_WINDOW) & low_complexity(F.substring(sequence, 1, WINDOW)), WINDOW).otherwise(0)
    left = F.length(sequence) - head
    tail = F.when((left - WINDOW >= MIN_AFTER_WINDOW) & low_complexity(F.right(sequence, F.lit(WINDOW))), WINDOW).otherwise(0)
    return F.struct(head.alias("n"), tail.alias("c"))


def leader_cut(sequence: Column) -> Column:
    """Where a hydrophobic leader ends (15 to 37), 0 if there is none: the best scored cut."""
    # fixed values: letters of a membrane stretch, and the bulky ones among them
    loose, bulky = "AILMFWVYCT", "ILVFMYW"

    def of(cut: Column) -> Column:
        region = F.substr(sequence, F.lit(4), F.greatest(F.lit(6), cut - 3) - 3)
        lead = F.substr(sequence, F.lit(2), cut - 1)
        a, b, ra, rb = share(region, loose), share(region, bulky), longest_run(lead, loose), longest_run(lead, bulky)
        charged = F.length(region) - F.length(F.regexp_replace(region, "[DEKRH]", ""))
        small = lambda at: F.substr(sequence, at, F.lit(1)).rlike("^[ASGTVCP]$")
        ok = (F.length(region) >= 8) & (a >= 0.60) & (b >= 0.35) & (ra >= 7) & (rb >= 4) & (charged <= 3) & small(cut - 2) & small(cut)
        return F.struct(F.when(ok, a * 2.0 + b + ra / 10.0 + rb / 20.0 - charged * 0.12 + cut / 100.0).alias("score"), (-cut).alias("minus"))

    cuts = F.sequence(F.lit(15), F.least(F.lit(37), F.length(sequence) - 80))
    best = F.array_max(F.filter(F.transform(cuts, of), lambda s: s["score"] > 0))
    return F.when((F.length(sequence) >= 95) & F.startswith(sequence, F.lit("M")), F.coalesce(-best["minus"], F.lit(0))).otherwise(0)


def variable_end(sequence: Column) -> Column:
    """End of a variable domain: the least end of a known motif's first place, 85 to 135 with 50 letters after; null if none."""
    ends = F.array(*(F.when(F.locate(m, sequence) > 0, F.locate(m, sequence) + len(m) - 1) for m in VARIABLE_ENDS))
    fits = F.filter(ends, lambda e: e.between(85, 135) & (F.length(sequence) - e >= 50))
    known = reduce(lambda a, b: a | b, (F.startswith(sequence, F.lit(p)) for p in VARIABLE_STARTS))
    return F.when((F.length(sequence) >= 160) & known, F.array_min(fits))


def chain_name(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA."""
    letter = lambda i: F.char(i % 26 + 65)
    return F.when(index < 26, letter(index)).otherwise(F.concat(letter(F.floor(index / 26) - 1), letter(index)))


def csv_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def padded(values: Column, i: Column) -> Column:
    """The i-th value, or the last where there are fewer."""
    return F.coalesce(F.get(values, i), F.element_at(values, -1))
