"""Imports, exports, set operations, lookups and statistics against plain versions on random block sets."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from blockmatch.functions import codec
from blockmatch.operators import merge, scan, setops, stats
from blockmatch.operators.blockset import BlockSet
from blockmatch.operators.scan import ScanMode
from blockmatch.sources import lists


class Plain:
    """A block set in dictionaries, filled row by row."""

    def __init__(self):
        self.pairs, self.attributes, self.sources, self.names = {}, {}, {}, set()

    def lines(self):
        out = []
        for h, (entropy, label) in sorted(self.attributes.items()):
            own = [x for (b, f), n in sorted(self.pairs.items()) if b == h for x in (f, n)]
            out.append(json.dumps({"block_hash": h, "k_entropy": entropy, "block_label": label, "source_sub_counts": own}, separators=(",", ":")))
        return out + [self.source_line(f) for f in sorted(self.sources)]

    def source_line(self, f):
        size, kind, zero, flagged = self.sources[f]
        own = [x for g, r, n in sorted(self.names) if g == f for x in (r, n)]
        return json.dumps({"file_hash": f, "filesize": size, "file_type": kind, "zero_count": zero, "nonprobative_count": flagged, "name_pairs": own}, separators=(",", ":"), ensure_ascii=False)

    def count(self, h):
        return sum(n for (b, _), n in self.pairs.items() if b == h)

    def where(self, keep, other=None, names=None):
        """The pairs that ``keep`` takes, with what belongs to them; source data from here, else from ``other``."""
        out, sets = Plain(), [self, *([other] if other else [])]
        for s in sets[::-1]:
            out.pairs |= {k: n for k, n in s.pairs.items() if keep(*k)}
            out.attributes |= s.attributes
            out.sources |= s.sources
            out.names |= s.names if names is None else {x for x in s.names if names(x)}
        blocks, files = {h for h, _ in out.pairs}, {f for _, f in out.pairs}
        out.attributes = {h: x for h, x in out.attributes.items() if h in blocks}
        out.sources = {f: x for f, x in out.sources.items() if f in files}
        out.names = {x for x in out.names if x[0] in files}
        return out


def random_set(seed, blocks, files, shift=0):
    rng = random.Random(seed)
    out = Plain()
    blocks, files = [f"{x:04x}c0de{x * 7919 % 65536:04x}" for x in blocks], [f"f11e{x:06x}" for x in files]
    for f in files:
        out.sources[f] = (rng.randrange(10**6) + shift, rng.choice(["", "txt", 'q"\\']), rng.randrange(9), rng.randrange(9))
        out.names |= {(f, f"depot{rng.randrange(3)}", f"path/{shift}/{rng.randrange(50)} é.bin") for _ in range(rng.randrange(3))}
    for h in blocks:
        out.attributes[h] = (rng.randrange(9000) + shift, rng.choice(["", "H", "RM"]))
        for f in rng.sample(files, rng.randrange(1, 5)):
            out.pairs[h, f] = rng.randrange(1, 30)
    used = {f for _, f in out.pairs}
    out.sources = {f: x for f, x in out.sources.items() if f in used}
    out.names = {x for x in out.names if x[0] in used}
    return out


A, B = random_set(1, range(40), range(12)), random_set(2, range(25, 60), range(6, 20), 10**7)


def load(spark, lines):
    parsed = lists.parse_json(lists.of_lines(spark, lines))
    return merge.merge(parsed.events, BlockSet.empty(spark), parsed.sources, parsed.names)


def exported(held):
    return [r["value"] for r in lists.export_json(held).orderBy("kind", "key").collect()]


@pytest.fixture(scope="module")
def sets(spark):
    return load(spark, A.lines()).materialise(), load(spark, B.lines()).materialise()


def approximate(n):
    """The largest count of the same code: steps of 5 ** e below 20 * 5 ** e."""
    e = next(e for e in range(20) if n + 5 < 20 * 5**e)
    return (n + 5) // 5**e * 5**e - 5


def expanded(s, h, shown):
    files = sorted(f for b, f in s.pairs if b == h)
    head = {"block_hash": h, "k_entropy": s.attributes[h][0], "block_label": s.attributes[h][1], "count": s.count(h), "source_list_id": zlib.crc32(bytes.fromhex("".join(files)))}
    tail = [x for f in files for x in (f, s.pairs[h, f])]
    return json.dumps(head, separators=(",", ":"))[:-1] + f',"sources":[{",".join(s.source_line(f) for f in files if f in shown)}],"source_sub_counts":{json.dumps(tail, separators=(",", ":"))}}}'


def probe_lines(seed):
    rng = random.Random(seed)
    text = ["# begin"]
    for k in range(60):
        h = rng.choice([*A.attributes, *B.attributes])
        text.append(rng.choice([f"at {k}\t{h}", f"at {k}\t{h.upper()}", f"at {k}\t{h}\tmore", f"at {k}\t{h}0", f"at {k}\tno hash", "# note", ""]))
    return text


@pytest.mark.parametrize("mode", list(ScanMode))
def test_scan_list(spark, sets, mode):
    text = probe_lines(3)
    probes, comments, invalid = lists.parse_probes(lists.of_lines(spark, text))
    want, seen, shown, bad = [], set(), set(), []
    for k, line in enumerate(text):
        label, *rest = line.split("\t")
        if not line or line.startswith("#"):
            continue
        try:
            bytes.fromhex("zz" if len(rest) != 1 else rest[0])
        except ValueError:
            bad.append(k)
            continue
        h = rest[0].lower()
        if h not in A.attributes:
            continue
        short = f'{{"block_hash":"{h}"'
        if mode is ScanMode.COUNT:
            text_of = f'{short},"count":{A.count(h)}}}'
        elif mode is ScanMode.APPROXIMATE_COUNT:
            text_of = f'{short},"approximate_count":{approximate(A.count(h))}}}'
        elif mode is ScanMode.EXPANDED:
            text_of = expanded(A, h, set(A.sources))
        elif h in seen:
            text_of = short + "}"
        else:
            files = {f for b, f in A.pairs if b == h}
            text_of = expanded(A, h, files - shown)
            shown |= files
        seen.add(h)
        want.append(f"{label}\t{h}\t{text_of}")
    assert [r["value"] for r in scan.lines(scan.scan(sets[0], probes, mode)).orderBy("line").collect()] == want
    assert [r["line"] for r in comments.orderBy("line").collect()] == [k for k, x in enumerate(text) if x.startswith("#")]
    assert sorted(r["line"] for r in invalid.collect()) == bad and bad and want


def test_json_round_trip_and_range(spark, sets):
    assert exported(sets[0]) == A.lines()
    assert exported(load(spark, A.lines()[::-1])) == A.lines()
    low, high = sorted(A.attributes)[5], sorted(A.attributes)[17]
    part = A.where(lambda h, f: low <= h <= high)
    rows = lists.export_json(sets[0], bytes.fromhex(low), bytes.fromhex(high)).orderBy("kind", "key").collect()
    assert [r["value"] for r in rows] == part.lines() and 0 < len(part.sources) < len(A.sources)
    with pytest.raises(ValueError):
        lists.export_json(sets[0], b"\2", b"\1")


def test_invalid_json_lines(spark):
    lines = ["# comment", "", "no json", '{"x":1}', '{"block_hash":"abc","source_sub_counts":[]}', '{"block_hash":"ab","source_sub_counts":["1c",1,"zz",2,"2d",3]}', '{"file_hash":"1c","name_pairs":[]}', '{"file_hash":"1c","filesize":1,"name_pairs":["r"]}', '{"block_hash":"cd","source_sub_counts":["1c",0]}', "[1]"]
    parsed = lists.parse_json(lists.of_lines(spark, lines))
    assert sorted(r["line"] for r in parsed.invalid.collect()) == [2, 3, 4, 5, 6, 7, 8, 9]
    held = merge.merge(parsed.events, BlockSet.empty(spark)).hash_source.collect()
    assert [(r["block_hash"].hex(), r["file_hash"].hex(), r["sub_count"]) for r in held] == [("ab", "1c", 1)]


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("operation", ["intersect", "intersect_hash", "subtract", "subtract_hash", "add", "add_multiple"])
def test_operations_on_two_sets(spark, sets, operation, swap):
    a, b = (B, A) if swap else (A, B)
    held = sets[::-1] if swap else sets
    keep = {
        "intersect": lambda h, f: (h, f) in a.pairs and (h, f) in b.pairs,
        "intersect_hash": lambda h, f: h in a.attributes and h in b.attributes,
        "subtract": lambda h, f: (h, f) in a.pairs and (h, f) not in b.pairs,
        "subtract_hash": lambda h, f: (h, f) in a.pairs and h not in b.attributes,
        "add": lambda h, f: (h, f) in b.pairs or f not in b.sources,
        "add_multiple": lambda h, f: True,
    }[operation]
    if operation == "add":  # A into the destination B: sources that B holds keep to what they have
        want = b.where(keep, a)
        want.names = {x for x in want.names if x[0] not in b.sources or x in b.names}
        out = setops.add(held[0], held[1])
    elif operation == "add_multiple":
        want = a.where(keep, b)
        want.sources |= b.sources  # of later sets
        out = setops.add_multiple(held)
    else:
        want, out = a.where(keep, b), getattr(setops, operation)(*held)
    assert exported(out) == want.lines() and want.pairs
    if operation in ("intersect", "add"):
        assert exported(setops.add(out, out)) == exported(out)


def test_repositories_and_ranges(spark, sets):
    for build, names in ((setops.add_repository, lambda x: x[1] == "depot1"), (setops.subtract_repository, lambda x: x[1] != "depot1")):
        files = {x[0] for x in A.names if names(x)}
        assert exported(build(sets[0], "depot1")) == A.where(lambda h, f, files=files: f in files, names=names).lines()
    for least, most in ((0, 10), (10, 0), (12, 40), (1, 1)):
        want = A.where(lambda h, f, least=least, most=most: A.count(h) >= least and (not most or A.count(h) <= most))
        assert exported(setops.add_range(sets[0], least, most)) == want.lines()
    kinds = {r["file_hash"].hex(): (r["in_repository"], r["in_other"]) for r in setops.repository_kinds(sets[0], "depot1").collect()}
    assert kinds == {f: tuple(any((r == "depot1") == own for g, r, _ in A.names if g == f) for own in (True, False)) for f in {x[0] for x in A.names}}


def test_tab_import(spark, sets):
    rng = random.Random(4)
    rows = [(rng.choice([*A.sources, "beef01", "beef02"]), rng.choice([*A.attributes, *B.attributes]), 512 * k) for k in range(80)]
    text = ["# comment", *("\t".join(map(str, r)) for r in rows), "broken", "beef01\tzz\t1", ""]
    parsed = lists.parse_tab(lists.of_lines(spark, text), "depot", "list.tab")
    held = merge.insert(parsed.events, BlockSet.empty(spark), parsed.sources, parsed.names)
    want = Plain()
    for f, h, _ in rows:
        want.pairs[h, f] = want.pairs.get((h, f), 0) + 1
        want.attributes[h], want.sources[f] = (0, ""), (0, "", 0, 0)
        want.names.add((f, "depot", "list.tab"))
    assert exported(held) == want.lines() and sorted(r["line"] for r in parsed.invalid.collect()) == [81, 82]
    marked = lists.parse_tab(lists.of_lines(spark, text), "depot", "list.tab", held=sets[0], whitelist=sets[1])
    events = sorted((r["file_hash"].hex(), r["block_hash"].hex(), r["block_label"]) for r in marked.events.collect())
    assert events == sorted((f, h, "w" if h in B.attributes else "") for f, h, _ in rows if f not in A.sources)


def test_statistics(spark, sets):
    counts = [A.count(h) for h in A.attributes]
    total = stats.totals(sets[0]).first().asDict()
    assert total == {"total_hashes": sum(counts), "total_distinct_hashes": counts.count(1), "n_distinct": len(counts)}
    assert sorted(map(tuple, stats.histogram(sets[0]).collect())) == [(n, counts.count(n), n * counts.count(n)) for n in sorted(set(counts))]
    for n in (counts[0], 10**6):
        assert sorted(r["block_hash"].hex() for r in stats.duplicates(sets[0], n).collect()) == sorted(h for h in A.attributes if A.count(h) == n)
    f = sorted(A.sources)[3]
    assert sorted((r["block_hash"].hex(), r["sub_count"]) for r in scan.hash_table(sets[0], bytes.fromhex(f)).collect()) == sorted((h, n) for (h, g), n in A.pairs.items() if g == f)
    held = [sum(h == b for b, _ in A.pairs) for h in A.attributes]
    prefixes = {h[:14] for h in A.attributes}
    assert tuple(stats.sizes(sets[0]).first()) == (sum(n if n == 1 else n + 1 for n in held), len(prefixes), len(A.sources), len(A.sources), len(A.names))
    assert tuple(stats.sizes(BlockSet.empty(spark)).first()) == (0, 0, 0, 0, 0)
    keys, key = sorted(A.attributes), None
    for want in [*keys[:3], None]:
        key = scan.next_key(sets[0].hash, "block_hash", key if want else bytes.fromhex(keys[-1]))
        assert key == (bytes.fromhex(want) if want else None)


def events(spark, rows):
    data = [(bytearray.fromhex(b), e, label, bytearray.fromhex(f), n, k) for k, (b, e, label, f, n) in enumerate(rows)]
    return spark.createDataFrame(data, "block_hash binary, k_entropy long, block_label string, file_hash binary, sub_count long, seq long")


def random_events(seed, n, most=40):
    rng = random.Random(seed)
    return [(rng.choice([*list(A.attributes)[:8], "dead00", "dead01"]), rng.choice([5, 5, 6]), rng.choice(["H", "H", "label of many bytes"]), rng.choice([*list(A.sources)[:4], "beef01"]), rng.randrange(1, most)) for _ in range(n)]


@pytest.mark.parametrize("how", ["merge", "insert"])
def test_changes_equal_those_of_single_steps(spark, sets, how):
    rows = random_events(5, 120)
    pairs, attributes, counted = dict(A.pairs), dict(A.attributes), dict.fromkeys(merge.COUNTERS[:6], 0)
    touched = set(A.sources)
    ids = [0, 0]
    for h, entropy, label, f, n in rows:
        label = label.encode()[:10].decode()
        ids[f in touched] += 1
        touched.add(f)
        counted["hash_inserted"] += not any(b == h for b, _ in pairs)
        first = attributes.setdefault(h, (entropy, label))
        counted["hash_data_mismatched_data_detected"] += first != (entropy, label)
        if how == "insert":
            counted["hash_data_inserted"] += 1
            pairs[h, f] = min(pairs.get((h, f), 0) + n, 65535)
        elif (h, f) in pairs:
            counted["hash_data_merged_same"] += 1
            counted["hash_data_mismatched_sub_count_detected"] += pairs[h, f] != n
        else:
            counted["hash_data_merged"] += 1
            pairs[h, f] = n
    found = merge.changes(events(spark, rows), sets[0], how).first().asDict()
    assert {k: found[k] for k in counted} == counted and [found["source_id_inserted"], found["source_id_already_present"]] == ids
    out = getattr(merge, how)(events(spark, rows), sets[0])
    assert {(r["block_hash"].hex(), r["file_hash"].hex()): r["sub_count"] for r in out.hash_source.collect()} == pairs
    assert {r["block_hash"].hex(): (r["k_entropy"], r["block_label"]) for r in out.hash.collect()} == attributes
    if how == "merge":
        assert exported(merge.merge(events(spark, rows), out)) == exported(out)


def test_insert_saturates(spark):
    held = merge.insert(events(spark, [("ab", 1, "", "f1", 65_000), ("ab", 1, "", "f1", 600), ("ab", 1, "", "f2", 7)]), BlockSet.empty(spark))
    assert sorted((r["file_hash"].hex(), r["sub_count"]) for r in held.hash_source.collect()) == [("f1", 65_535), ("f2", 7)]
    assert held.hash.first()["count"] == 65_607


@pytest.mark.parametrize("n", [1, 37, 640])
def test_codes_change_as_counts_grow(spark, n):
    counted = merge.changes(events(spark, [("ab", 0, "", "f1", 1)] * n), BlockSet.empty(spark), "insert").first().asDict()
    steps = sum(approximate(k) != approximate(k - 1) for k in range(2, n + 1))
    assert (counted["hash_data_inserted"], counted["hash_inserted"], counted["hash_count_changed"], counted["hash_count_not_changed"]) == (n, 1, steps, n - 1 - steps)
    assert merge.report({"hash_inserted": 1}) == ["# changes:", "#     hash_inserted: 1"] and merge.report({}) == ["# No changes."]


def test_codecs(spark):
    row = spark.range(1).select(
        codec.hex_to_bin(F.lit("0aFf")).alias("a"), codec.hex_to_bin(F.lit("abc")).alias("b"), codec.hex_to_bin(F.lit("")).alias("c"),
        codec.label(F.lit("äöüäöüäöü")).alias("label"), codec.to_uint64(F.lit("12x")).alias("n"), codec.to_uint64(F.lit("x")).alias("z"),
    ).first()
    assert (bytes(row["a"]), row["b"], row["c"], row["label"], row["n"], row["z"]) == (b"\x0a\xff", None, None, "äöüäö", 12, 0)
    assert all(r[1] == approximate(r[0]) for r in spark.range(1, 5000).select("id", codec.approximate_count("id")).collect())


def test_line_order_of_many_partitions(spark):
    """Numbers of lines are those of the input, in partitions above 1024 too, and the first record wins."""
    rows = spark.range(0, 3000, 1, 1500).select("id", F.format_string('{"block_hash":"%04x","k_entropy":%d,"source_sub_counts":["f1",1,"f2",2]}', F.col("id") % 700, "id").alias("value"))
    numbered = rows.select((F.monotonically_increasing_id() + (1 << 50)).alias("line"), "value")
    held = merge.merge(lists.parse_json(numbered).events, BlockSet.empty(spark))
    assert {r["block_hash"].hex(): r["k_entropy"] for r in held.hash.collect()} == {f"{k:04x}": k for k in range(700)}


def test_lines_of_files_are_numbered(spark, tmp_path):
    text = [f"line {k} {'x' * (k % 7)}" for k in range(500)]
    (tmp_path / "b.txt").write_text("\n".join(text[:100]) + "\n")
    (tmp_path / "c.txt").write_text("\n".join(text[100:]))
    (tmp_path / "a.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = lists.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line"], r["value"]) for r in rows) == list(enumerate(text))


def test_queries_leave_no_line_item_out(spark, tmp_path):
    from blockmatch.plans.queries import queries

    items = [(o, p, o % 7 + 1) for o in range(1, 61) for p in (o % 10 + 1, 15)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(o, 1, "O", 10.5, "1-URGENT") for o in range(1, 61)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    every = queries()
    assert every["q_totals"](spark, str(tmp_path)).first()["total_hashes"] == len(items)
    assert every["q_import_json"](spark, str(tmp_path)).count() == len(items)
    assert every["q_merge"](spark, str(tmp_path)).count() == every["q_add_multiple"](spark, str(tmp_path)).count() == len(items)
