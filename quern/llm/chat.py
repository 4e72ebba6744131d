r"""Chat formatting by token-level assembly.

Each turn is encoded apart and spliced between reserved ids that no text can give:
an opening id for its role, the text's ids, the closing id. As text the template reads

    ### Assistant: the text</turn>\n

with System, User, Assistant and Tool for the roles in lower case; any other role is written as
"### Role: <role>### End: <text></turn>\n". Control strings inside roles and texts are broken by a
backslash, `</turn>` as `<\/turn>` and `### User: ` as `#\## User: `, and a backslash is doubled,
so that dropping the first of every backslash and its follower gives the text back.
The loss mask comes from prefix sums over the reserved ids: it is on between the assistant's
opening id and the closing id, both excluded.

Scale: rows are encoded where they are read. Assembly sorts the turns of a partition by
conversation and streams, carrying a running offset, so that a conversation of any length
passes through bounded memory.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
KNOWN_ROLES = ("system", "user", "assistant", "tool")
#: Reserved ids follow the vocabulary's 50,256, in this order; the strings are what they read as.
FIRST_RESERVED = 50256
CONTROLS = tuple(f"### {r.capitalize()}: " for r in KNOWN_ROLES) + ("### Role: ", "### End: ", "</turn>\n")
SYSTEM, USER, ASSISTANT, TOOL, ROLE, ROLE_END, CLOSE = range(FIRST_RESERVED, FIRST_RESERVED + len(CONTROLS))
_NAMES = "|".join([*(r.capitalize() for r in KNOWN_ROLES), "Role", "End"])
_CONTROL = re.compile(rf"\\|(?<=<)/(?=turn>)|(?<=#)##(?= (?:{_NAMES}):)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: White space (Unicode's property) in long runs, which the tokenizer's regular expression has no stack for.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def escape(text: str) -> str:
    """text with every backslash doubled and every control string broken by one."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """Ids of text and back, for one worker."""

    def __init__(self, path: str | None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The tokenizer's ids of the whole text.

        A long run of white space is taken out and encoded as the one piece that it is to the
        tokenizer: all of it at the text's end, else all but its last character, which goes with
        what follows.
        """
        out, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self.coder.encode_ordinary(text[at : m.start()])
            out += self.coder._encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + self.coder.encode_ordinary(text[at:])

    def decode(self, ids) -> str:
        return self.coder.decode_bytes(ids).decode("utf-8")


def encode_turn(codec: Codec, role: str, text: str) -> list[int]:
    body = codec.encode(escape(text))
    if role in KNOWN_ROLES:
        return [FIRST_RESERVED + KNOWN_ROLES.index(role), *body, CLOSE]
    return [ROLE, *codec.encode(escape(role)), ROLE_END, *body, CLOSE]


def loss_mask(ids: np.ndarray) -> np.ndarray:
    """True on the ids of the assistant's texts: the prefix sum of openings is the turn that an id is in."""
    opens = (ids >= SYSTEM) & (ids <= ROLE)
    learned = np.concatenate([[False], ids[opens] == ASSISTANT])
    return learned[np.cumsum(opens)] & (ids < FIRST_RESERVED)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per turn, as pieces of each conversation's sequence: conv, turn, offset (ids before it), ids, mask.

    The sequence of a conversation is its rows' ids in the order of turn (null first; ties by role
    and text). Null roles and texts count as empty. Null conversation ids are one conversation.
    """
    kinds = dict(turns.dtypes)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        codec, last, offset = Codec(path), object(), 0
        for batch in batches:
            convs, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            offsets, ids, masks = [], [], []
            for c, r, t in zip(convs, roles, texts):
                if c != last:
                    last, offset = c, 0
                own = np.array(encode_turn(codec, r, t), dtype=np.int32)
                offsets.append(offset)
                ids.append(own)
                masks.append(loss_mask(own))
                offset += len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(offsets, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))],
                names=[conv, turn, "offset", "ids", "mask"],
            )

    return ordered.mapInArrow(run, f"`{conv}` {kinds[conv]}, `{turn}` {kinds[turn]}, offset long, ids array<int>, mask array<boolean>")


def split_turn(codec: Codec, ids: np.ndarray) -> tuple[str, str]:
    """Role and text of a turn's ids, unescaped."""
    if ids[0] != ROLE:
        return KNOWN_ROLES[ids[0] - FIRST_RESERVED], unescape(codec.decode(ids[1:-1].tolist()))
    end = int(np.flatnonzero(ids == ROLE_END)[0])
    return unescape(codec.decode(ids[1:end].tolist())), unescape(codec.decode(ids[end + 1 : -1].tolist()))


def render(codec: Codec, ids: np.ndarray) -> str:
    """The sequence as text, reserved ids as their strings."""
    out, at = [], 0
    for stop in [*np.flatnonzero(ids >= FIRST_RESERVED).tolist(), len(ids)]:
        if stop > at:
            out.append(codec.decode(ids[at:stop].tolist()))
        if stop < len(ids):
            out.append(CONTROLS[ids[stop] - FIRST_RESERVED])
        at = stop + 1
    return "".join(out)


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn", path: str | None = None) -> DataFrame:
    """One row per conversation, from format_turns' ids and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = dict(formatted.dtypes)[conv]
    ordered = formatted.select(F.col(conv).alias("conv"), "offset", "ids", "mask").repartition("conv").sortWithinPartitions("conv", "offset")
    schema = f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        import pyarrow as pa

        codec, open_, state = Codec(path), False, None
        conv_type = None

        def closed():
            c, n, turns, chars, loss, size = state
            return [c, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        def out(rows):
            columns = list(zip(*rows))
            kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = (conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=list(names))

        for batch in batches:
            conv_type, rows = batch.column(0).type, []
            for i, c in enumerate(batch.column(0).to_pylist()):
                if not open_ or c != state[0]:
                    if open_:
                        rows.append(closed())
                    open_, state = True, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = batch.column(2)[i].values.to_numpy()
                mask = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                role, text = split_turn(codec, ids)
                loss = unescape(codec.decode(ids[mask].tolist())) if mask.any() else ""
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(render(codec, ids))
            if rows:
                yield out(rows)
        if open_:
            yield out([closed()])

    return ordered.mapInArrow(run, schema)
