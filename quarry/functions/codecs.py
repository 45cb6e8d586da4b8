"""Scalar codecs as Column expressions: hashes, base32, paths, sizes, ranges, and the line-based info text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The base32 alphabet, the separator of canonical encodings, the default compression of the info text.
ALPHABET = "0123456789abcdfghijklmnpqrsvwxyz"
SEPARATOR = "\x1f"
DEFAULT_COMPRESSION = "bzip2"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(*fields: Column | str) -> Column:
    """One unambiguous text of the fields: null differs from the empty text, arrays are joined in order."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.concat(F.lit("="), col(f).cast("string")), F.lit("-")) for f in fields])


def fact_hash(*fields: Column | str) -> Column:
    """sha256 of the canonical text, in hex."""
    return F.sha2(canonical(*fields), 256)


def half(hex_: Column | str, k: int) -> Column:
    """The k-th 64 bits of a hex hash as a signed long."""
    return F.conv(F.substring(col(hex_), 16 * k + 1, 16), 16, -10).cast("long")


def leaf_of(hex_: Column | str) -> Column:
    """The top 16 bits."""
    return F.conv(F.substring(col(hex_), 1, 4), 16, 10).cast("int")


def base32(hex_: Column | str, size: int = 32) -> Column:
    """Bytes given in hex to base32, low bits first and the highest character in front."""
    length = (size * 8 - 1) // 5 + 1
    h = F.concat(col(hex_), F.lit("00"))  # a zero byte above the highest

    def char(n: Column) -> Column:
        byte = (n * 5 / 8).cast("int")
        pair = F.concat(F.substr(h, 2 * byte + 3, F.lit(2)), F.substr(h, 2 * byte + 1, F.lit(2)))
        value = F.floor(F.conv(pair, 16, 10).cast("int") / F.pow(F.lit(2), n * 5 % 8)).cast("int")
        return F.substr(F.lit(ALPHABET), value % 32 + 1, F.lit(1))

    return F.when(F.length(col(hex_)) == 2 * size, F.array_join(F.transform(F.sequence(F.lit(length - 1), F.lit(0), F.lit(-1)), char), ""))


def unbase32(text: Column | str, size: int = 32) -> Column:
    """base32 to hex; null for another length, a foreign character, or bits beyond the last byte."""
    t = col(text)
    length = (size * 8 - 1) // 5 + 1
    spill = length * 5 - size * 8
    bits = F.array_join(F.transform(F.split(t, ""), lambda c: F.lpad(F.bin(F.position(c, F.lit(ALPHABET)) - 1), 5, "0")), "")
    good = (F.length(t) == length) & t.rlike(f"^[{ALPHABET}]*$")

    def hexed(b: Column) -> Column:
        two = lambda k: F.lpad(F.conv(F.substr(b, k * 8 + spill + 1, F.lit(8)), 2, 16), 2, "0")
        return F.when(F.substr(b, F.lit(1), F.lit(spill)) == "0" * spill, F.lower(F.array_join(F.transform(F.sequence(F.lit(size - 1), F.lit(0), F.lit(-1)), two), "")))

    # the bits are computed once, as the one element of an array
    return F.when(good, F.element_at(F.transform(F.array(bits), hexed), 1))


def hash_column(text: Column | str) -> Column:
    """sha256:<64 hex or 52 base32> to hex, else null."""
    body = F.regexp_extract(col(text), "^sha256:(.*)$", 1)
    return F.when(F.length(body) == 64, F.when(body.rlike("^[0-9a-fA-F]*$"), F.lower(body))).when(F.length(body) == 52, unbase32(body))


def hash_part(path: Column | str) -> Column:
    """The first 32 characters after the last slash, empty if there are fewer."""
    part = F.substring(F.substring_index(col(path), "/", -1), 1, 32)
    return F.when(F.length(part) == 32, part).otherwise("")


def basename(path: Column | str, store: str) -> Column:
    """The path without the store's directory, unchanged outside of it."""
    p = col(path)
    return F.when(p.startswith(f"{store}/"), F.substr(p, F.lit(len(store) + 2))).otherwise(p)


def fingerprint(path: Column, hex_: Column, size: Column, refs: Column) -> Column:
    """1;path;sha256:base32;size;ref,ref with the references sorted: what a signature covers."""
    return F.concat_ws(";", F.lit("1"), path, F.concat(F.lit("sha256:"), base32(hex_)), size.cast("string"), F.array_join(F.array_sort(refs), ","))


def byte_size(text: Column | str) -> Column:
    """'512', '16MiB', '1.5KiB' to bytes; null for any other unit."""
    t = F.trim(col(text))
    number, unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)$", 1), F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)$", 2)
    scale = F.when(unit.isin("", "B"), 1.0)
    for k, name in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        scale = scale.when(unit == name, float(1024**k))
    return (F.when(number != "", number).try_cast("double") * scale).cast("long")


def byte_range(header: Column | str, size: Column | str) -> Column:
    """A single bytes= range to struct(kind, start, end): full, partial or unsatisfiable."""
    h, n = col(header), col(size)
    spec = F.trim(F.regexp_extract(h, "^bytes=(.*)$", 1))
    a, b = F.regexp_extract(spec, "^([^-]*)-(.*)$", 1), F.regexp_extract(spec, "^([^-]*)-(.*)$", 2)
    number = lambda c: F.when(F.when(c.rlike("^[0-9]+$"), c).try_cast("decimal(38,0)") < F.lit(str(2**64)).cast("decimal(38,0)"), c.try_cast("decimal(38,0)"))
    first, last = number(a), number(b)
    out = lambda kind, s=None, e=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if s is None else s).cast("long").alias("start"), (F.lit(None) if e is None else e).cast("long").alias("end"))
    full, bad = out("full"), out("unsatisfiable")
    shape = h.isNotNull() & h.startswith("bytes=") & ~F.contains(spec, F.lit(",")) & F.contains(spec, F.lit("-"))
    suffix = F.when(last.isNull(), full).when((last == 0) | (n == 0), bad).otherwise(out("partial", F.greatest(n - last, F.lit(0)), n))
    opened = F.when(first.isNull(), full).when(first >= n, bad).otherwise(out("partial", first, n))
    both = F.when(first.isNull() | last.isNull(), full).when((first > last) | (first >= n), bad).otherwise(out("partial", first, F.least(last + 1, n)))
    return F.when(~F.coalesce(shape, F.lit(False)), full).when(a == "", suffix).when(b == "", opened).otherwise(both)


def info_text(path: Column, hex_: Column, size: Column, refs: Column, deriver: Column, sigs: Column, ca: Column) -> Column:
    """The line-based description of one content; absent fields leave no line."""
    b32 = base32(hex_)
    line = lambda key, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{key}: "), value))
    lines = [
        F.concat(F.lit("StorePath: "), path), F.concat(F.lit("URL: nar/"), b32, F.lit(".nar")), F.lit("Compression: none"),
        F.concat(F.lit("FileHash: sha256:"), b32), F.concat(F.lit("FileSize: "), size.cast("string")), F.concat(F.lit("NarHash: sha256:"), b32),
        F.concat(F.lit("NarSize: "), size.cast("string")), F.concat(F.lit("References: "), F.array_join(refs, " ")), line("Deriver", deriver),
        F.when(F.size(sigs) > 0, F.array_join(F.transform(sigs, lambda s: F.concat(F.lit("Sig: "), s)), "\n")), line("CA", ca),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def parsed_info(text: Column | str) -> Column:
    """The info text to a struct; null if path, address, hash or size are missing or broken."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: x != "")
    values = lambda key: F.transform(F.filter(lines, lambda x: x.startswith(f"{key}:")), lambda x: F.regexp_replace(x, f"^{key}: ?", ""))
    last = lambda key: F.try_element_at(values(key), F.lit(-1))
    some = lambda c: F.when(c != "", c)
    body = F.struct(
        last("StorePath").alias("path"), F.coalesce(last("Compression"), F.lit(DEFAULT_COMPRESSION)).alias("compression"), hash_column(last("NarHash")).alias("content"),
        last("NarSize").try_cast("long").alias("size"), F.filter(F.split(F.coalesce(last("References"), F.lit("")), r"\s+"), lambda x: x != "").alias("refs"),
        some(last("Deriver")).alias("deriver"), some(last("CA")).alias("ca"), F.filter(values("Sig"), lambda x: x != "").alias("sigs"),
    )
    ok = last("URL").isNotNull() & last("StorePath").isNotNull() & body["content"].isNotNull() & body["size"].isNotNull() & F.forall(lines, lambda x: F.contains(x, F.lit(":")))
    return F.when(ok, body)


def pressure_avg10(text: Column | str, line: str = "some") -> Column:
    """avg10 of a pressure text's line."""
    return F.regexp_extract(col(text), rf"(?m)^{line}\s.*?avg10=([0-9.]+)", 1).try_cast("double")


def ramp(value: Column, zero: float, one: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - zero) / (one - zero)))


def severity(own: Column, system: Column, fill: Column, available: Column) -> Column:
    """The largest of the signals' ramps; a signal that can't be read counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.greatest(zero(ramp(own, 0.5, 5.0)), zero(ramp(system, 2.0, 20.0)), zero(ramp(fill, 0.75, 0.95)), zero(ramp(available, 0.10, 0.05)))


def meminfo(text: Column | str, key: str) -> Column:
    """Bytes of a line `key: n kB` of a memory text."""
    return F.regexp_extract(col(text), rf"(?m)^{key}:\s*([0-9]+) kB", 1).try_cast("long") * 1024


def clean_of(text: Column | str, *marks: str) -> Column:
    """Whether a text has none of the marks; a text that can't be read has none."""
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(col(text), F.lit(m))
    return F.coalesce(~found, F.lit(True))


def refused(roaming: Column, size: Column, least_rate: float, grace: float) -> Column:
    """Whether a transfer is refused while roaming: too large for the least rate in the time of grace; never, if no rate is asked."""
    return F.lit(least_rate > 0) & F.coalesce(roaming, F.lit(False)) & F.coalesce(size > least_rate * grace, F.lit(False))
