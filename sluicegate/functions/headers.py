"""Header look-up and scalar parsing, all as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names of the record format.
SENDER = "sender"
SENDER_TIMESTAMP = "sender-timestamp"
MESSAGE_ID = "message_id"

# Digits per part of a canonical UUID.
UUID_PART_WIDTHS = (8, 4, 4, 4, 12)
UUID_TEXT_LENGTH = 36

# Readable forms of the keys.
KEY_TEXT_SEPARATOR = ":"
SENDER_PARTITION_FORMAT = "SenderPartitionKey{sender='%s', topic='%s', partition=%d}"
SENDER_MESSAGE_FORMAT = "SenderMessageIdKey{sender='%s', messageId=%s}"

_BLANKS = "".join(chr(c) for c in range(0x21))
_DECIMAL = r"\A[+-]?[0-9]+\z"
_CANONICAL_UUID = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
# One part is a non-negative hexadecimal number below 2**63, leading zeros allowed.
_UUID_PART = r"\+?0*(?:[0-7][0-9a-f]{15}|[0-9a-f]{1,15})"
_LENIENT_UUID = rf"\A{_UUID_PART}(?:-{_UUID_PART}){{4}}\z"


def header_last(headers: Column, name: str) -> Column:
    """Text of the last header called ``name``; NULL if there is none.

    Bytes that are not UTF-8 become U+FFFD; a header without bytes counts as missing.
    """
    from_end = F.array_position(F.reverse(headers["key"]), F.lit(name)).cast("int")
    value = F.when(from_end > 0, F.try_element_at(headers["value"], -from_end))
    return F.make_valid_utf8(value.cast("string"))


def trim_blank(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.trim(text, F.lit(_BLANKS))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def parse_epoch_ms(text: Column) -> Column:
    """Signed decimal text as bigint; NULL if it is no 64-bit number.

    No surrounding blanks are allowed, ASCII digits only.
    """
    return F.when(text.rlike(_DECIMAL), text.try_cast("bigint"))


def sender_instant(epoch_ms: Column) -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(epoch_ms)


def uuid_canonical(text: Column) -> Column:
    """Lower-case 36-character form of a UUID text; NULL if it is not one.

    Parts may be short (padded with zeros) or long (the low digits count).
    """
    lower = F.lower(text)
    widths = F.array(*[F.lit(w) for w in UUID_PART_WIDTHS])

    def fit(part: Column, i: Column) -> Column:
        width = F.element_at(widths, i + 1)
        digits = F.ltrim(part, F.lit("+"))
        return F.right(F.lpad(digits, F.greatest(F.length(digits), width), F.lit("0")), width)

    lenient = F.array_join(F.transform(F.split(lower, "-"), fit), "-")
    return F.when(lower.rlike(_CANONICAL_UUID), lower).when(
        (F.length(text) <= UUID_TEXT_LENGTH) & lower.rlike(_LENIENT_UUID), lenient
    )


def key_text(sender_key: Column, message_id: Column) -> Column:
    """``sender:uuid`` form of a uniqueness key; NULL unless both parts are there."""
    return F.when(sender_key.isNotNull() & message_id.isNotNull(),
                  F.concat(sender_key, F.lit(KEY_TEXT_SEPARATOR), message_id))


def sender_partition_text(sender: Column, topic: Column, partition: Column) -> Column:
    """Readable form of a watermark key."""
    return F.format_string(SENDER_PARTITION_FORMAT, sender, topic, partition)


def sender_message_text(sender: Column, message_id: Column) -> Column:
    """Readable form of a uniqueness key."""
    return F.format_string(SENDER_MESSAGE_FORMAT, sender, message_id)
