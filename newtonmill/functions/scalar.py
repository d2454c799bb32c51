"""Scalar functions as Column expressions: arithmetic, bits, strings, digests and the linear congruential generator."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    """-1 for negative x, else 1."""
    return F.when(x < 0, -1).otherwise(1)


def round_half_down(x: Column) -> Column:
    """The integer part, one more where the fraction is over one half."""
    whole = F.floor(x)
    return F.when(x - whole > 0.5, whole + 1).otherwise(whole).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def multiple_up(x: Column, m: int) -> Column:
    return (F.ceil(x / F.lit(float(m))) * m).cast("long")


def multiple_down(x: Column, m: int) -> Column:
    return (F.floor(x / F.lit(float(m))) * m).cast("long")


def log_floor(x: Column, base: int) -> Column:
    """The greatest k with base ** k <= x, for positive integers below 10 ** 15."""
    k = F.floor(F.log(x.cast("double")) / F.log(F.lit(float(base))))
    power = lambda e: F.round(F.pow(F.lit(float(base)), e))
    return F.when(power(k) > x, k - 1).when(power(k + 1) <= x, k + 1).otherwise(k).cast("long")


def is_prime(x: Column) -> Column:
    divisors = F.sequence(F.lit(2), F.greatest(F.floor(F.sqrt(x.cast("double"))), F.lit(2)).cast("int"))
    return (x >= 2) & F.forall(divisors, lambda d: (x % d != 0) | (x == d))


def power_mod(base: Column, exponent: int, modulus: int) -> Column:
    """base ** exponent modulo a modulus under 2 ** 31, by squaring."""
    out, square = F.lit(1).cast("long"), F.pmod(base.cast("long"), F.lit(modulus))
    while exponent:
        if exponent & 1:
            out = F.pmod(out * square, F.lit(modulus))
        square = F.pmod(square * square, F.lit(modulus))
        exponent >>= 1
    return out


def swap_bytes(x: Column, size: int) -> Column:
    """An unsigned integer of 2 or 4 bytes with its bytes in the opposite order."""
    parts = [F.shiftleft(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)), 8 * (size - 1 - k)) for k in range(size)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def low_bits(x: Column, n: int) -> Column:
    """The n lowest bits, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.call_function("getbit", x, k).cast("int"))


def byte_of_bits(bits: list[Column]) -> Column:
    """The byte with the bits given, lowest first."""
    out = F.lit(0)
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(b.cast("int"), k))
    return out


def power_of_two_floor(x: Column) -> Column:
    """Sign and exponent of x with the mantissa cut off: the power of two next towards 0. 0 and subnormals give 0."""
    p = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))))
    near = F.when(p > F.abs(x), p / 2).when(2 * p <= F.abs(x), 2 * p).otherwise(p)
    return F.when(F.abs(x) < 2.2250738585072014e-308, 0.0).otherwise(F.signum(x) * near)


def parse_int(text: Column) -> Column:
    """An integer with at most one sign; null for anything else."""
    return F.when(F.regexp_like(text, F.lit(r"^[+-]?[0-9]+$")), F.regexp_replace(text, r"^\+", "").try_cast("long"))


def parse_double(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$")), F.regexp_replace(text, r"^\+", "").try_cast("double"))


def array_text(a: Column) -> Column:
    """[1,222,3]"""
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))


def tokens(text: Column, separators: str) -> Column:
    """The parts between separator characters (a pattern class), without empty ones."""
    return F.filter(F.split(text, f"[{separators}]"), lambda t: t != "")


def crc32_open(data: Column) -> Column:
    """CRC-32 without the final inversion."""
    return F.crc32(data).bitwiseXOR(F.lit(4294967295))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+", "/")


#: Multiplier and increment of the 32-bit generator. Fixed values.
LCG_A, LCG_C = 214013, 2531011


def lcg_next(state: Column) -> Column:
    return F.pmod(state * F.lit(LCG_A) + F.lit(LCG_C), F.lit(4294967296))


def lcg_stream(seed: Column, n: int) -> Column:
    """The n states that follow seed."""
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(seed.cast("long")), lambda a, _: F.concat(a, F.array(lcg_next(F.element_at(a, -1))))), 2, n)


def lcg_reals(seed: Column, n: int, low: float = 0.0, high: float = 1.0) -> Column:
    """The n states that follow seed as numbers from low to high, both included."""
    return F.transform(lcg_stream(seed, n), lambda x: F.lit(low) + x / F.lit(float((1 << 32) - 1)) * F.lit(high - low))


def c_runtime_stream(seed: Column, n: int) -> Column:
    """n numbers from 0 to 32767, as a C run-time library draws them: 15 bits of the states that follow seed."""
    return F.transform(lcg_stream(seed, n), lambda x: F.shiftright(x, 16).bitwiseAND(F.lit((1 << 15) - 1)))


def exponent(x: Column) -> Column:
    """The binary exponent of a normal number: x is its sign times its mantissa, in [1, 2), times 2 to the exponent. Null for 0."""
    e = F.floor(F.log2(F.abs(x)))
    p = F.pow(F.lit(2.0), e)
    return F.when(x == 0, None).when(p > F.abs(x), e - 1).when(2 * p <= F.abs(x), e + 1).otherwise(e).cast("int")


def mantissa(x: Column) -> Column:
    """The mantissa of a normal number, in [1, 2); 0 for 0."""
    return F.when(x == 0, 0.0).otherwise(F.abs(x / power_of_two_floor(x)))


def nonempty_lines(text: Column) -> Column:
    """Line ends that do not follow another, carriage returns left out: what stands behind the last line end is no line, and white space is text."""
    return F.regexp_count(F.regexp_replace(text, "\r", ""), F.lit("\n+"))


def uniform(key: Column, *salt: Column) -> Column:
    """A number in [0, 1) that depends on key and salt alone, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(key, *salt), 11) / F.lit(float(1 << 53))


def exponential(u: Column, rate: float) -> Column:
    return -F.log(1 - u) / F.lit(float(rate))


def rayleigh(u: Column, sigma: float) -> Column:
    return F.lit(float(sigma)) * F.sqrt(-2 * F.log(1 - u))


def normal(u: Column, v: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """A normal number from two uniform ones."""
    return F.lit(float(mean)) + rayleigh(u, sigma) * F.cos(2 * F.pi() * v)


def chi_square(draws: list[Column]) -> Column:
    """From independent standard normal numbers."""
    return sum((d * d for d in draws[1:]), draws[0] * draws[0])
