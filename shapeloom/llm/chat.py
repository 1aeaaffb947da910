"""Chat formatting with DataFrame functions only.

Records come in several layouts. The nested field paths of a record are hashed; the hash selects a
declarative mapping (`LAYOUTS`) that turns it into canonical turns (conv_id, turn, role, text). A
table has one layout, told from its schema; JSON records are told apart row by row.

Template: user `[INST]…[/INST]`, assistant `<s>…</s>`, system `<<SYS>>…<</SYS>>`, any other role
`[ROLE]role[/ROLE]…[/TURN]`. Inside texts a backslash is doubled and one is put into each control
string after its first character, so that no text holds a control string; undoing it is exact.

Defined cases: a null text or role is empty; turns are ordered by turn, role, text, nulls first;
rows with a null conv_id form one conversation; repeated rows are turns of their own; texts may be
of any length; other columns are ignored; an empty table gives an empty one.
"""
import hashlib

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"]
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
TURN = (r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[/ROLE\].*?\[/TURN\]")

# Declarative mappings: the field paths of a layout, and its turns as (role, text) paths or as an
# array with role and text fields. `turn` marks tables with one row per turn.
LAYOUTS = [
    {"name": "turn_rows", "paths": ["conv_id", "role", "text", "turn"], "role": "role", "text": "text", "turn": "turn"},
    {"name": "messages", "paths": ["conv_id", "messages[].content", "messages[].role"],
     "array": "messages", "role": "role", "text": "content"},
    {"name": "share", "paths": ["conv_id", "conversations[].from", "conversations[].value"],
     "array": "conversations", "role": "from", "text": "value"},
    {"name": "prompt", "paths": ["conv_id", "prompt", "response"],
     "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "instruction", "paths": ["conv_id", "input", "instruction", "output"],
     "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "instruction_only", "paths": ["conv_id", "instruction", "output"],
     "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "system_prompt", "paths": ["conv_id", "prompt", "response", "system"],
     "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
]
# Role names of arrays; rows that are turns already keep theirs.
NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
SAID = "array<struct<turn:bigint,role:string,text:string>>"


class UnknownLayout(ValueError):
    pass


def digest(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


REGISTRY = {digest(m["paths"]): m for m in LAYOUTS}
KNOWN = sorted({p for m in LAYOUTS for p in m["paths"]})


def paths_of(schema: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema; `[]` marks an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, prefix + "[]")
    return [prefix]


def layout_of(df: DataFrame, registry=None) -> dict:
    """The mapping whose paths hash like those of the table; paths that no mapping uses don't count.

    Where the table holds more known paths than one layout has, the layout with most paths wins.
    """
    registry = REGISTRY if registry is None else registry
    known = {p for m in registry.values() for p in m["paths"]}
    have = set(paths_of(df.schema)) & known
    if (found := registry.get(digest(have))) is not None:
        return found
    inside = [m for m in registry.values() if set(m["paths"]) <= have]
    if not inside:
        raise UnknownLayout(f"no layout for the paths {sorted(have)}")
    return registry[digest(max(inside, key=lambda m: (len(m["paths"]), m["name"]))["paths"])]


def _role(role):
    role = F.coalesce(role, F.lit(""))
    named = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, role), role)


def _turn(i, role, text):
    return F.struct(F.lit(i).cast("long").alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _item(layout):
    """An element of a layout's array as a turn."""
    return lambda x, i: F.struct(i.cast("long").alias("turn"), _role(x[layout["role"]]).alias("role"),
                                 F.coalesce(x[layout["text"]], F.lit("")).alias("text"))


def _joined(fields):
    """Prompt and optional input; an empty or null part is left out."""
    return F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in fields])


def canonical(df: DataFrame, registry=None) -> DataFrame:
    """Turns (conv_id, turn, role, text) of a table in any registered layout."""
    layout = layout_of(df, registry)
    key = F.col("conv_id").cast("long").alias("conv_id")
    if "turn" in layout:
        return df.select(key, F.col(layout["turn"]).cast("long").alias("turn"),
                         F.coalesce(layout["role"], F.lit("")).alias("role"), F.coalesce(layout["text"], F.lit("")).alias("text"))
    if "array" in layout:
        said = F.transform(F.col(layout["array"]), _item(layout))
    else:
        said = F.array(*[_turn(i, F.lit(role), _joined([F.col(c) for c in fields]))
                         for i, (role, fields) in enumerate(layout["turns"])])
    return df.select(key, F.explode(said.cast(SAID)).alias("t")).select("conv_id", "t.*")


def record_fingerprint(record):
    """Hash of the nested field paths of a JSON record; the first element stands for an array."""
    def under(c):
        head = F.call_function("get_json_object", record, F.concat(F.lit("$['"), c, F.lit("'][0]")))
        inner = F.coalesce(F.json_object_keys(head), F.array().cast("array<string>"))
        return F.when(F.size(inner) > 0, F.transform(inner, lambda k: F.concat(c, F.lit("[]."), k))).otherwise(F.array(c))

    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    known = F.array(*[F.lit(p) for p in KNOWN])
    found = F.array_intersect(F.flatten(F.transform(top, under)), known)
    return F.sha2(F.array_join(F.array_sort(found), "\n"), 256)


def canonical_json(df: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Turns of JSON records of mixed layouts, and the records whose fingerprint is not registered."""
    marked = df.select(F.col(record).alias("record"), record_fingerprint(F.col(record)).alias("fingerprint"))
    text = lambda p: F.get_json_object("record", f"$.{p}")
    said = F.lit(None).cast(SAID)
    for mark, m in REGISTRY.items():
        if "turn" in m:
            turns = F.array(F.struct(text("turn").cast("long").alias("turn"), F.coalesce(text("role"), F.lit("")).alias("role"),
                                     F.coalesce(text("text"), F.lit("")).alias("text")))
        elif "array" in m:
            items = F.from_json(text(m["array"]), f"array<struct<{m['role']}:string,{m['text']}:string>>".replace("from:", "`from`:"))
            turns = F.transform(items, _item(m))
        else:
            turns = F.array(*[_turn(i, F.lit(r), _joined([text(c) for c in f])) for i, (r, f) in enumerate(m["turns"])])
        said = F.when(F.col("fingerprint") == mark, turns.cast(SAID)).otherwise(said)
    known = F.col("fingerprint").isin(*REGISTRY)
    turns = (marked.filter(known).select(text("conv_id").cast("long").alias("conv_id"), F.explode(said).alias("t"))
             .select("conv_id", "t.*"))
    return turns, marked.filter(F.coalesce(~known, F.lit(True)))


def escape(text):
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role, text):
    """A turn in the template, and the length of what stands before its text."""
    safe = escape(text)
    other_head = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"))
    head, whole = other_head, F.concat(other_head, safe, F.lit("[/TURN]"))
    for name, (a, b) in MARKS.items():
        head = F.when(role == name, F.lit(a)).otherwise(head)
        whole = F.when(role == name, F.concat(F.lit(a), safe, F.lit(b))).otherwise(whole)
    return whole, F.char_length(head), F.char_length(safe)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: `formatted`, and `loss_spans` (start, length in code points) over it.

    A turn is rendered before the one shuffle, which brings a conversation, itself one output value,
    together; offsets come from a running sum there.
    """
    whole, before, size = render(F.col("role"), F.col("text"))
    parts = turns.select("conv_id", "turn", "role", "text", whole.alias("part"), before.cast("long").alias("before"),
                         size.cast("long").alias("size"))
    by = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    parts = (parts.withColumn("n", F.row_number().over(by))
             .withColumn("end", F.sum(F.char_length("part").cast("long")).over(by.rowsBetween(W.unboundedPreceding, 0)))
             .withColumn("start", F.col("end") - F.char_length("part") + F.col("before")))
    # Grouping reuses the partitions of the window; n is unique, so sorting never compares texts.
    said = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "part"))).alias("t"),
                                        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct(
                                            "start", F.col("size").alias("length"))))).alias("loss_spans"))
    return said.select("conv_id", F.array_join(F.transform("t", lambda t: t["part"]), "").alias("formatted"), "loss_spans")


def parse(formatted):
    """Turns (role, text) read back from the output, unescaped."""
    def one(p):
        role, text = F.regexp_extract(p, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1), F.regexp_extract(
            p, r"(?s)^\[ROLE\].*?\[/ROLE\](.*)\[/TURN\]$", 1)
        for name, (a, b) in MARKS.items():
            role = F.when(F.startswith(p, F.lit(a)), F.lit(name)).otherwise(role)
            text = F.when(F.startswith(p, F.lit(a)), F.substring(p, F.lit(len(a) + 1), F.char_length(p) - (len(a) + len(b)))).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def loss_text(formatted, spans):
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
