"""Session logs (a tree of records) to events: the live branch, tool calls with their results, pending text."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import shared, text, variants
from .events import as_events
from .render import quoted

#: The place of what comes at a segment's end.
FAR = 1 << 60
#: Rows of segments that a worker has as objects at a time, but for those of the segment at hand.
WALKED = 1000


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("rec"), path, kind)


def leaves(records: DataFrame) -> DataFrame:
    """session, leaf: the first summary's leafUuid that is in the file, else the last uuid. records: session, lineno, rec VARIANT."""
    r = records.select("session", "lineno", get("$.uuid").alias("uuid"), F.when(get("$.type") == "summary", get("$.leafUuid")).alias("named"))
    known = r.filter("uuid <> ''").select("session", F.col("uuid").alias("named")).distinct()
    named = r.filter("named is not null").join(known, ["session", "named"], "left_semi").groupBy("session").agg(F.min_by("named", "lineno").alias("named"))
    last = r.filter("uuid <> ''").groupBy("session").agg(F.max_by("uuid", "lineno").alias("last"))
    return last.join(named, "session", "left").select("session", F.coalesce("named", "last").alias("leaf"))


def chains(nodes: DataFrame, leaf: DataFrame, most_rounds: int = 32) -> DataFrame:
    """session, uuid, depth of all nodes from the leaf up, the leaf having depth 0.

    nodes: session, uuid, parent. Pointer doubling: after round k each node knows its ancestor 2**k
    steps up, so a chain of n nodes needs log2(n) joins, not n. A cycle ends where it would repeat.
    """
    here = nodes.select("session", "uuid", F.col("parent").alias("up")).dropDuplicates(["session", "uuid"])
    present = here.select("session", F.col("uuid").alias("up"))
    here = here.join(present, ["session", "up"], "left_semi").select("session", "uuid", "up").unionByName(here.join(present, ["session", "up"], "left_anti").select("session", "uuid", F.lit(None).cast("string").alias("up")))
    reached = leaf.join(here.select("session", F.col("uuid").alias("leaf")), ["session", "leaf"], "left_semi").select("session", F.col("leaf").alias("uuid"), F.lit(0).cast("long").alias("depth"))
    step, size = 1, -1
    for _ in range(most_rounds):
        further = reached.join(here.filter("up is not null"), ["session", "uuid"]).select("session", F.col("up").alias("uuid"), (F.col("depth") + step).alias("depth"))
        reached = reached.unionByName(further).groupBy("session", "uuid").agg(F.min("depth").alias("depth")).checkpoint()
        now = reached.count()
        if now in (0, size):
            break
        size, step = now, step * 2
        jump = here.select("session", F.col("uuid").alias("up"), F.col("up").alias("upper"))
        here = here.join(jump, ["session", "up"], "left").select("session", "uuid", F.col("upper").alias("up")).checkpoint()
    return reached


def _chained(nodes: DataFrame, leaf: DataFrame) -> DataFrame:
    """As chains(), of nodes with lineno. In most sessions a record's parent is the one before it or missing: their chain is the unbroken run of lines that
    ends at the leaf, found by one window; only sessions with any other link take chains()."""
    by_line = Window.partitionBy("session").orderBy("lineno", "uuid")
    follows = F.coalesce(F.col("parent") == F.lag("uuid").over(by_line), F.lit(False))
    n = nodes.select("session", "uuid", "parent", F.row_number().over(by_line).cast("long").alias("at"), follows.alias("follows"))
    n = n.withColumn("start", F.max(F.when(~F.col("follows"), F.col("at"))).over(by_line.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).checkpoint()
    far = n.filter("parent is not null and not follows").select("session", "parent")
    odd = far.join(n.select("session", F.col("uuid").alias("parent")), ["session", "parent"], "left_semi").select("session").distinct().checkpoint()
    plain = leaf.join(odd, "session", "left_anti").withColumnRenamed("leaf", "uuid")
    ends = n.join(plain, ["session", "uuid"], "left_semi").select("session", F.col("at").alias("end"), "start")
    runs = n.join(ends, ["session", "start"]).filter("at <= end").select("session", "uuid", (F.col("end") - F.col("at")).alias("depth"))
    return runs.unionByName(chains(n.join(odd, "session", "left_semi"), leaf.join(odd, "session", "left_semi")))


def linear(records: DataFrame, use_parent_chain: bool = True) -> DataFrame:
    """session, pos, lineno, rec: message records in conversation order.

    That is the parent chain of the leaf, or line order where the leaf is no message or the chain
    holds less than half of the messages (a parent is missing).
    """
    messages = records.filter((get("$.uuid") != "") & F.schema_of_variant(get("$.message", "variant")).startswith("OBJECT"))
    by_line = Window.partitionBy("session").orderBy("lineno")
    if not use_parent_chain:
        return messages.select("session", F.row_number().over(by_line).alias("pos"), "lineno", "rec")
    nodes = messages.select("session", "lineno", get("$.uuid").alias("uuid"), F.nullif(get("$.parentUuid"), F.lit("")).alias("parent"))
    nodes = nodes.groupBy("session", "uuid").agg(F.max_by("parent", "lineno").alias("parent"), F.max("lineno").alias("lineno"))
    chain = _chained(nodes, leaves(records))
    sizes = messages.groupBy("session").agg(F.count("*").alias("n")).join(chain.groupBy("session").agg(F.count("*").alias("k")), "session", "left")
    good = sizes.select("session", (F.coalesce("k", F.lit(0)) >= F.greatest(F.lit(1), F.expr("n div 2"))).alias("chained"))
    of = nodes.join(chain, ["session", "uuid"]).select("session", "lineno", "depth")
    m = messages.join(good, "session").join(of, ["session", "lineno"], "left").filter("not chained or depth is not null")
    return m.select("session", F.row_number().over(Window.partitionBy("session").orderBy(F.when(F.col("chained"), -F.col("depth")), "lineno")).alias("pos"), "lineno", "rec")


def blocks(messages: DataFrame) -> DataFrame:
    """One row per content block: session, p (place), lineno, role, uuid, parent, block_index, type, text, id, tool, input, error, normal (a user message without results)."""
    role = F.coalesce(get("$.message.role"), get("$.type"))
    items = variants.blocks(get("$.message.content", "variant"))
    m = messages.select("session", "pos", "lineno", role.alias("role"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent"), items.alias("items"))
    given = F.exists("items", lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == "tool_result", F.lit(False)))
    m = m.withColumn("normal", (F.col("role") == "user") & ~F.coalesce(given, F.lit(False)))
    v = lambda path, kind="string": F.try_variant_get(F.col("b"), path, kind)
    b = m.select("session", "pos", "lineno", "role", "uuid", "parent", "normal", F.posexplode_outer("items").alias("block_index", "b"))
    type_ = v("$.type")
    raw = F.when(type_ == "text", v("$.text", "variant")).when(type_ == "thinking", v("$.thinking", "variant")).when(type_ == "tool_result", v("$.content", "variant")).when(type_ != "tool_use", F.col("b"))
    b = b.select(
        "session", "pos", "lineno", "role", "uuid", "parent", "normal", "block_index", type_.alias("type"), variants.content_text(raw).alias("text"), F.coalesce(v("$.id"), v("$.tool_use_id"), F.lit("")).alias("id"),
        v("$.name").alias("tool"), F.to_json(v("$.input", "variant")).alias("input"), F.coalesce(v("$.is_error", "boolean"), F.lit(False)).alias("error"),
    )
    return b.withColumn("p", F.row_number().over(Window.partitionBy("session").orderBy("pos", "block_index")).cast("long"))


def queued(calls: DataFrame) -> DataFrame:
    """Where actions and results of parallel tool calls go, as in emission_order(), also where ids are missing or come twice: adds dropped too.

    A result belongs to the call of its id that waits, or without an id to the first that waits; of two results of a call that waits the later
    one counts, and the earlier is dropped. Which call that is depends on all results before, so a segment with such ids is
    walked through in order by one task, a small row for each call or result; other segments have their places in closed form.
    """
    nth = F.row_number().over(Window.partitionBy("session", "seg", "kind", "id").orderBy("p"))
    odd = F.max((F.coalesce("id", F.lit("")) == "") | (F.col("__nth") > 1)).over(Window.partitionBy("session", "seg"))
    marked = calls.withColumn("__nth", nth).withColumn("__odd", odd).drop("__nth")
    plain = emission_order(marked.filter("not __odd").drop("__odd")).withColumn("dropped", F.lit(False))
    names = [*calls.columns, "k1", "k2", "k3", "k4", "paired", "dropped"]
    plain = plain.select(*calls.columns, *(F.col(c).cast("long").alias(c) for c in ("k1", "k2", "k3", "k4")), "paired", "dropped")
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in plain.schema.fields])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments stream by one after another; a worker holds one, and a few rows that are done."""
        now, rows, done = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, WALKED):
                for r in batch.slice(at, WALKED).to_pylist():
                    if (r["session"], r["seg"]) != now:
                        done += walked(rows)
                        now, rows = (r["session"], r["seg"]), []
                    rows.append(r)
                if len(done) >= WALKED:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
        yield pa.RecordBatch.from_pylist(done + walked(rows), schema)

    fixed = marked.filter("__odd").drop("__odd").repartition("session", "seg").sortWithinPartitions("session", "seg", "p").mapInArrow(walks, plain.schema)
    return plain.unionByName(fixed.select(*names))


def walked(rows: list[dict]) -> list[dict]:
    """A segment's calls and results, in order, with their places: see queued()."""
    for r in rows:
        r |= {"id": r["id"] or "", "k1": r["p"], "k2": 1, "k3": r["p"], "k4": 0, "paired": False, "dropped": False}
    waiting: deque[dict] = deque()
    wanted: Counter[str] = Counter()  # the waiting calls' ids
    held: dict[str, dict] = {}
    for r in rows:
        if r["kind"] == "action":
            waiting.append(r)
            wanted[r["id"]] += 1
            continue
        known = wanted[r["id"]] > 0
        if not known and (r["id"] or not waiting):
            continue  # a stray result stays where it is
        key = r["id"] if known else waiting[0]["id"]
        if key in held:
            held[key]["dropped"] = True
        held[key] = r  # keeps the place of the first
        while waiting and waiting[0]["id"] in held:
            call = waiting.popleft()
            wanted[call["id"]] -= 1
            answer = held.pop(call["id"])
            call |= {"k1": r["p"], "paired": True}
            answer |= {"k1": r["p"], "k3": call["p"], "k4": 1, "paired": True}
    for call in waiting:
        call |= {"k1": FAR, "k2": 2}
    for n, answer in enumerate(held.values()):
        answer |= {"k1": FAR, "k2": 3, "k3": n, "paired": True}
    for call in waiting:
        call["paired"] = call["id"] in held
    return rows


def emission_order(calls: DataFrame) -> DataFrame:
    """Where actions and results of parallel tool calls go: adds k1, k2, k3, k4 to sort by, and paired.

    calls: session, seg, p, kind ('action' or 'result'), id. In a segment (between normal user
    messages), a call and its result come out together once all calls before have their results: at
    the running maximum of the results' places. Calls that stay blocked come out at the
    segment's end, then the results they held back. A result of no call stays where it is. Ids must be unique among a segment's calls and
    among its results; see queued() for others.
    """
    a = calls.filter("kind = 'action'")
    r = calls.filter("kind = 'result'").select("session", "seg", "id", F.col("p").alias("rp"))
    match = a.join(r, ["session", "seg", "id"], "left").withColumn("rp", F.when(F.col("rp") > F.col("p"), F.col("rp")))
    match = match.groupBy("session", "seg", "id", "p").agg(F.min("rp").alias("rp"))
    w = Window.partitionBy("session", "seg").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    far = F.lit(FAR)
    match = match.withColumn("m", F.max(F.coalesce("rp", far)).over(w))
    free = F.col("m") < far
    acts = match.select("session", "p", F.when(free, F.col("m")).otherwise(far).alias("k1"), F.when(free, 1).otherwise(2).alias("k2"), F.col("p").alias("k3"), F.lit(0).alias("k4"), F.col("rp").isNotNull().alias("paired"))
    res = match.filter("rp is not null").select("session", F.col("rp").alias("p"), F.when(free, F.col("m")).otherwise(far).alias("k1"), F.when(free, 1).otherwise(3).alias("k2"), F.when(free, F.col("p")).otherwise(F.col("rp")).alias("k3"), F.when(free, 1).otherwise(0).alias("k4"), F.lit(True).alias("paired"))
    found = acts.unionByName(res)
    out = calls.join(found, ["session", "p"], "left")
    return out.withColumns({"k1": F.coalesce("k1", "p"), "k2": F.coalesce("k2", F.lit(1)), "k3": F.coalesce("k3", "p"), "k4": F.coalesce("k4", F.lit(0)), "paired": F.coalesce("paired", F.lit(False))})


def events(records: DataFrame, use_parent_chain: bool = True, drop_thinking: bool = False, lowercase_functions: bool = False, keep_parallel_order: bool = False, chain: DataFrame | None = None) -> DataFrame:
    """Events of session records (session, lineno, rec VARIANT); traj_id is the session. chain: linear(records), where the caller has it.

    Text and thoughts of the assistant wait for the next tool call, whose description and
    reasoning they become; what no call takes is a message before the next normal user message.
    The blocks are stored in the shared folder, since most steps read them.
    """
    out, _ = _converted(linear(records, use_parent_chain) if chain is None else chain, drop_thinking, lowercase_functions, keep_parallel_order)
    return out


def _converted(chain: DataFrame, drop_thinking: bool, lowercase_functions: bool, keep_parallel_order: bool) -> tuple[DataFrame, DataFrame]:
    """(events, warnings: session, seg, k1, k2, k3, said) of messages in order."""
    everything = blocks(chain)
    by = Window.partitionBy("session").orderBy("p")
    first = F.col("normal") & (F.row_number().over(Window.partitionBy("session", "pos").orderBy("block_index")) == 1)
    call = (F.col("role") == "assistant") & (F.col("type") == "tool_use")
    everything = everything.withColumn("first", first).withColumn("own", F.col("type").isNotNull() | F.col("first"))  # a user message without blocks ends a segment too
    stop = F.when(F.col("own"), (F.coalesce(call, F.lit(False)) | F.col("first")).cast("int"))
    everything = everything.withColumns({"seg": F.sum(F.when(F.col("own"), F.col("first").cast("int"))).over(by), "grp": F.sum(stop).over(by) - stop})
    everything = shared.stored(everything, "blocks")
    b = everything.filter("own").drop("own").withColumn("type", F.coalesce("type", F.lit("")))
    thought = (F.col("role") == "assistant") & (F.col("type") == "thinking")
    spoken = (F.col("role") == "assistant") & ~call & ~thought & (text.strip(F.col("text")) != "")
    pend = b.filter(spoken | (thought & F.lit(not drop_thinking) & (text.strip(F.col("text")) != ""))).withColumn("thought", F.col("type") == "thinking")
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("p", "text")))), lambda x: x["text"])
    prov = lambda kind: F.struct(F.col("lineno").cast("int").alias("raw_jsonl_line"), F.col("uuid").alias("raw_uuid"), F.col("parent").alias("raw_parent_uuid"), F.col("role").alias("raw_role"), kind.alias("raw_block_type"), F.col("block_index").alias("raw_block_index"), F.nullif("id", F.lit("")).alias("tool_use_id"))
    pend = pend.groupBy("session", "grp").agg(text.compact(ordered(~F.col("thought"))).alias("visible"), text.compact(ordered(F.col("thought"))).alias("reasoning"), F.max("seg").alias("seg"), F.max_by(F.when(~F.col("thought"), prov(F.lit("text"))), F.when(~F.col("thought"), F.col("p"))).alias("last"))

    tools = b.filter(call | ((F.col("role") == "user") & (F.col("type") == "tool_result")))
    tools = tools.withColumn("kind", F.when(call, "action").otherwise("result"))
    if keep_parallel_order:
        order = tools.select("session", "p", F.col("p").alias("k1"), F.lit(1).alias("k2"), F.col("p").alias("k3"), F.lit(0).alias("k4"))
        order = order.withColumns({"paired": F.lit(True), "dropped": F.lit(False)})
    else:
        order = queued(tools.select("session", "seg", "p", "kind", "id")).select("session", "p", "k1", "k2", "k3", "k4", "paired", "dropped")
    # the tool that was called last by this id before the result
    earlier = Window.partitionBy("session", "id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    tools = tools.withColumn("caller", F.last(F.when((F.col("kind") == "action") & (F.col("id") != ""), F.coalesce("tool", F.lit(""))), ignorenulls=True).over(earlier))
    t = tools.join(order, ["session", "p"])
    said = _pairing_warnings(t, b)
    t = t.join(pend.select("session", "grp", "visible", "reasoning"), ["session", "grp"], "left")
    name = F.concat(F.coalesce("caller", F.lit("tool")), F.when(F.col("id") != "", F.concat(F.lit(":"), F.col("id"))).otherwise(""), F.when(F.col("error"), ":error").otherwise(""))
    t = t.filter("not dropped")
    act = F.col("kind") == "action"
    obj = _as_object(F.col("input"))
    bash = act & (F.col("tool") == "Bash")
    own = F.get_json_object(obj, "$.description")
    rest = F.when(own.isNotNull(), variants.without_keys(F.parse_json(obj), "description")).otherwise(obj)
    fn = F.lower("tool") if lowercase_functions else F.col("tool")
    t = t.select(
        "session", "seg", "k1", "k2", "k3", "k4",
        F.when(bash, "code_action").when(act, "api_action").otherwise("text_observation").alias("class_"), F.when(~act, "environment").alias("source"), F.when(~act, name).alias("name"),
        F.when(bash, F.coalesce(F.get_json_object(obj, "$.command"), F.lit(""))).when(~act, F.col("text")).alias("content"), F.when(bash, "bash").alias("language"), F.when(act & ~bash, fn).alias("function"),
        F.when(act & ~bash, rest).alias("kwargs_json"), F.when(act, text.compact(F.array(F.coalesce("visible", F.lit("")), F.coalesce(own, F.lit(""))))).alias("description"), F.when(act, F.col("reasoning")).alias("reasoning_content"), prov(F.col("type")).alias("provenance"),
    )
    users = b.filter((F.col("role") == "user") & ~F.col("type").isin("tool_result", ""))
    users = users.select("session", "seg", F.col("p").alias("k1"), F.lit(1).alias("k2"), F.col("p").alias("k3"), F.lit(0).alias("k4"), F.lit("text_observation").alias("class_"), F.lit("user").alias("source"), F.lit("user").alias("name"), F.col("text").alias("content"), prov(F.lit("text")).alias("provenance"))
    taken = b.filter(call).select("session", "grp")
    left = pend.filter("visible is not null").join(taken, ["session", "grp"], "left_anti")
    left = left.select("session", "seg", F.lit(1 << 60).alias("k1"), F.lit(4).alias("k2"), F.col("grp").cast("long").alias("k3"), F.lit(0).alias("k4"), F.lit("message_action").alias("class_"), F.col("visible").alias("content"), F.col("reasoning").alias("reasoning_content"), F.col("last").alias("provenance"))
    out = t.unionByName(users, allowMissingColumns=True).unionByName(left, allowMissingColumns=True)
    out = out.withColumn("idx", F.row_number().over(Window.partitionBy("session").orderBy("seg", "k1", "k2", "k3", "k4")) - 1).withColumn("traj_id", F.col("session"))
    return as_events(out), said.unionByName(_block_warnings(everything, b))


def _pairing_warnings(tools: DataFrame, b: DataFrame) -> DataFrame:
    """session, seg, k1, k2, k3, said: calls without results, and results without calls that wait, where the conversion meets them."""
    last = b.groupBy("session").agg(F.max("seg").alias("last"))
    t = tools.join(last, "session")
    end = F.when(F.col("seg") == F.col("last"), "end of trajectory").otherwise("normal user message")
    id = quoted(F.col("id"))
    lost = F.concat(F.lit("Unpaired tool_use "), id, F.lit(" emitted without tool_result before "), end)
    at_end = F.when(F.col("seg") == F.col("last"), " had no pending tool_use at end of trajectory").otherwise(" had no pending tool_use before normal user message")
    stray = F.concat(F.lit("tool_result "), id, F.lit(" at line "), F.col("lineno").cast("string"), F.lit(" had no pending tool_use"))
    said = F.when((F.col("kind") == "action") & (F.col("k2") == 2), lost).when((F.col("kind") == "result") & (F.col("k2") == 3) & ~F.col("dropped"), F.concat(F.lit("tool_result "), id, at_end))
    said = said.when((F.col("kind") == "result") & ~F.col("paired") & ~F.col("dropped"), stray)
    return t.select("session", "seg", "k1", "k2", "k3", said.alias("said")).filter("said is not null")


def _block_warnings(everything: DataFrame, b: DataFrame) -> DataFrame:
    """The same for blocks of a type that isn't known, and messages of a role that isn't."""
    known = {"user": ("tool_result", "text", ""), "assistant": ("thinking", "text", "tool_use", "")}
    shown = F.coalesce(quoted(F.nullif("type", F.lit(""))), F.lit("None"))
    odd = F.when(F.col("role") == "user", ~F.col("type").isin(*known["user"])).when(F.col("role") == "assistant", ~F.col("type").isin(*known["assistant"]))
    blocks_ = b.filter(odd).select("session", "seg", F.col("p").alias("k1"), F.lit(1).cast("long").alias("k2"), F.col("p").alias("k3"), F.concat(F.lit("Unknown "), "role", F.lit(" content block type "), shown, F.lit(" at line "), F.col("lineno").cast("string")).alias("said"))
    role = everything.filter(~F.coalesce("role", F.lit("")).isin("user", "assistant")).groupBy("session", "pos").agg(F.min("p").alias("p"), F.first("role").alias("role"), F.first("lineno").alias("lineno"))
    before = b.filter("first").groupBy("session").agg(F.array_sort(F.collect_list("p")).alias("starts"))  # a number for each user message of a session
    role = role.join(before, "session", "left").withColumn("seg", F.coalesce(F.size(F.filter("starts", lambda s: s <= F.col("p"))), F.lit(0)).cast("long"))
    said = F.concat(F.lit("Unknown message role "), F.coalesce(quoted(F.col("role")), F.lit("None")), F.lit(" at line "), F.col("lineno").cast("string"))
    return blocks_.unionByName(role.select("session", "seg", F.col("p").alias("k1"), F.lit(1).cast("long").alias("k2"), F.col("p").alias("k3"), said.alias("said")))


def session_details(records: DataFrame, chain: DataFrame) -> DataFrame:
    """session, session_ids, versions, models, cwds, git_branches (sorted, distinct, over the chain), raw_record_count, message_record_count, converted_chain_record_count, summary."""
    listed = lambda path: F.array_sort(F.collect_set(F.nullif(get(path), F.lit(""))))
    c = chain.groupBy("session").agg(listed("$.sessionId").alias("session_ids"), listed("$.version").alias("versions"), listed("$.message.model").alias("models"), listed("$.cwd").alias("cwds"), listed("$.gitBranch").alias("git_branches"), F.count("*").alias("converted_chain_record_count"))
    message = (get("$.uuid") != "") & F.schema_of_variant(get("$.message", "variant")).startswith("OBJECT")
    r = records.groupBy("session").agg(
        F.count("*").alias("raw_record_count"), F.count_if(message).alias("message_record_count"), F.count_if(get("$.type") == "file-history-snapshot").alias("file_history_snapshot_count"),
        F.transform(F.array_sort(F.collect_list(F.when((get("$.type") == "summary") & (get("$.summary") != ""), F.struct("lineno", get("$.summary").alias("s"))))), lambda x: x["s"]).alias("summary"),
    )
    return r.join(c, "session", "left")


def record_digests(records: DataFrame) -> DataFrame:
    """session, digest: SHA-256 of a session's records in order, as one JSON list with sorted keys and each record's line number.

    Records stream by in order, one at a time, so a session of any size needs no more memory than its longest record. records: session, lineno, rec VARIANT and,
    if numbers must be as they are written, value (the line itself).
    """
    own = F.col("value") if "value" in records.columns else F.to_json("rec")
    rows = records.select("session", F.col("lineno").cast("long").alias("lineno"), own.alias("value"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        done: list[tuple[str, str]] = []

        def ended() -> None:
            if now is not None:
                sha.update(b"]")
                done.append((now, sha.hexdigest()))

        for batch in batches:
            for session, lineno, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if session != now:
                    ended()
                    now, sha = session, hashlib.sha256(b"[")
                else:
                    sha.update(b", ")
                record = json.loads(value) | {"_jsonl_lineno": lineno}
                sha.update(json.dumps(record, sort_keys=True, ensure_ascii=False).encode("utf-8", errors="replace"))
            if len(done) > 1000:
                yield pa.RecordBatch.from_pydict({"session": [x for x, _ in done], "digest": [x for _, x in done]})
                done.clear()
        ended()
        yield pa.RecordBatch.from_pydict({"session": pa.array([x for x, _ in done], pa.string()), "digest": pa.array([x for _, x in done], pa.string())})

    return rows.repartition("session").sortWithinPartitions("session", "lineno").mapInArrow(digest, "session string, digest string")


def trajectory_ids(records: DataFrame, session_ids: DataFrame, digits: int = 12) -> DataFrame:
    """session, id, traj_id: the single session id, else the file's stem and a short hash of the sorted ids or, without any, of the records.

    session_ids: session, session_ids (sorted). Only sessions without ids have their records read for it. Several files may have one id; traj_id, which keys
    tables, then has the file after it.
    """
    n = F.size("session_ids")
    stem = F.regexp_replace(F.substring_index("session", "/", -1), r"(?<=.)\.[^.]*$", "")
    none = session_ids.filter(n < 1).select("session")
    digests = record_digests(records.join(none, "session", "left_semi"))
    many = F.concat(stem, F.lit("-"), text.short_hash(F.array_join("session_ids", "|"), digits))
    t = session_ids.join(digests, "session", "left").select("session", F.when(n == 1, F.get("session_ids", F.lit(0))).when(n > 1, many).otherwise(F.concat(stem, F.lit("-"), F.left("digest", F.lit(digits)))).alias("id"))
    shared_by = t.groupBy("id").agg(F.count("*").alias("files"))
    return t.join(shared_by, "id").select("session", "id", F.when(F.col("files") > 1, F.concat("id", F.lit(" "), "session")).otherwise(F.col("id")).alias("traj_id"))


@dataclass(frozen=True)
class Converted:
    """events by traj_id; trajectories: session, id, traj_id, schema_version, details (JSON); warnings: session, n (from 0), said."""

    events: DataFrame
    trajectories: DataFrame
    warnings: DataFrame


def convert(records: DataFrame, use_parent_chain: bool = True, drop_thinking: bool = False, lowercase_functions: bool = False, keep_parallel_order: bool = False, raw_inputs: bool = True, raw_results: bool = True) -> Converted:
    """Sessions (session, lineno, rec VARIANT and optionally value, the line) with their ids, details and warnings.

    The chain and its blocks are stored in the shared folder, since events, details and warnings all read them. Details are a session's own: what its records
    name (ids, versions, models, folders, branches), counts, tools by call, summaries, the issue that the first user text states, warnings in the order the conversion meets them,
    and on demand the last input and result of every call.
    """
    chain = shared.stored(linear(records, use_parent_chain), "chain")
    events_, said = _converted(chain, drop_thinking, lowercase_functions, keep_parallel_order)
    order = Window.partitionBy("session").orderBy("seg", "k1", "k2", "k3", "said")
    warnings = said.select("session", (F.row_number().over(order) - 1).alias("n"), "said")
    own = session_details(records, chain)
    ids = trajectory_ids(records, own.select("session", F.coalesce("session_ids", F.array().cast("array<string>")).alias("session_ids")))

    b = blocks(chain)
    calls = b.filter("role = 'assistant' and type = 'tool_use' and id <> ''").groupBy("session", "id").agg(F.min("p").alias("first"), F.max_by(F.coalesce("tool", F.lit("")), "p").alias("tool"), F.max_by(_as_object(F.col("input")), "p").alias("input"))
    in_order = lambda c: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "id", c.alias("v")))), lambda x: F.struct(x["id"], x["v"])))
    parts = [calls.groupBy("session").agg(in_order(F.col("tool")).alias("tool_use_id_to_function"), in_order(F.col("input")).alias("inputs"))]
    results = chain.select("session", "pos", F.coalesce(get("$.message.role"), get("$.type")).alias("role"), F.try_variant_get("rec", "$.toolUseResult", "variant").alias("own"), F.posexplode(variants.blocks(get("$.message.content", "variant"))).alias("i", "x"))
    id = F.try_variant_get("x", "$.tool_use_id", "string")
    results = results.filter((F.col("role") == "user") & (F.try_variant_get("x", "$.type", "string") == "tool_result") & (id != ""))
    results = results.groupBy("session", id.alias("id")).agg(F.min(F.struct("pos", "i")).alias("first"), F.max_by(F.to_json(F.coalesce("own", "x")), F.struct("pos", "i")).alias("result"))
    parts.append(results.groupBy("session").agg(in_order(F.col("result")).alias("results")))
    user = b.filter((F.col("role") == "user") & (F.col("type") != "tool_result") & (text.strip(F.col("text")) != ""))
    parts.append(user.groupBy("session").agg(F.min_by("text", "p").alias("first_user_text")))
    parts.append(warnings.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]).alias("warnings")))
    t = reduce(lambda x, y: x.join(y, "session", "left"), parts, own)
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    nothing = F.create_map().cast("map<string,string>")
    parsed = lambda c: F.transform_values(F.coalesce(c, nothing), lambda _, v: F.parse_json(v))
    # names that details have (fixed values)
    details = F.struct(
        F.lit("claude_code_jsonl").alias("source_format"), F.col("session").alias("source_file"), listed("session_ids").alias("session_ids"), listed("versions").alias("claude_code_versions"), listed("models").alias("models"), listed("cwds").alias("cwd"),
        listed("git_branches").alias("git_branches"), "raw_record_count", "message_record_count", F.coalesce("converted_chain_record_count", F.lit(0)).alias("converted_chain_record_count"), F.coalesce("tool_use_id_to_function", nothing).alias("tool_use_id_to_function"),
        listed("summary").alias("summary"), text.issue_metadata(F.coalesce("first_user_text", F.lit(""))).alias("issue_metadata"), listed("warnings").alias("warnings"),
        *([parsed("inputs").alias("raw_tool_inputs_by_id")] if raw_inputs else []), *([parsed("results").alias("raw_tool_results_by_id")] if raw_results else []), "file_history_snapshot_count",
    )
    trajectories = t.join(ids, "session").select("session", "id", "traj_id", F.lit("1.1.0").alias("schema_version"), F.to_json(details).alias("details"))
    keyed = events_.withColumnRenamed("traj_id", "session").join(ids.select("session", "traj_id"), "session")
    return Converted(as_events(keyed), trajectories, warnings)


def _as_object(input: Column) -> Column:
    """JSON text of a call's input: an object as it is, nothing as {}, anything else as {"input": it}."""
    empty = F.coalesce(input, F.lit("null")).isin("null", '""', "[]", "0", "false")
    return F.when(empty, F.lit("{}")).when(input.startswith("{"), input).otherwise(F.concat(F.lit('{"input":'), input, F.lit("}")))


def adp_lines(converted: Converted) -> DataFrame:
    """session, traj_id, json: each trajectory as one object of id, schema_version, content and details, its items with the members that their class has."""
    e = converted.events
    some = lambda *names: F.to_json(F.struct("class_", *names, "provenance"))
    kwargs = F.parse_json(F.coalesce("kwargs_json", F.lit("{}"))).alias("kwargs")
    item = (
        F.when(F.col("class_") == "text_observation", some("content", "name", "source")).when(F.col("class_") == "api_action", some("function", kwargs, "description", "reasoning_content"))
        .when(F.col("class_") == "code_action", some("language", "content", "description", "reasoning_content")).otherwise(some("content", "description", "reasoning_content"))
    )
    items = e.groupBy("traj_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("x")))), lambda x: x["x"]), ",").alias("items"))
    t = converted.trajectories.join(items, "traj_id", "left")
    own = F.to_json(F.struct("schema_version", "id"))
    whole = F.concat(F.expr("left({0}, length({0}) - 1)".format("__own")), F.lit(',"content":['), F.coalesce("items", F.lit("")), F.lit('],"details":'), "details", F.lit("}"))
    return t.withColumn("__own", own).select("session", "traj_id", whole.alias("json"))
