"""Sequence functions on array columns: truncation, padding, masks, labels,
downmix, resampling, augmentation (T3-T8, T10, G1, G2, G7-G9).

All are higher-order Catalyst expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_INDEX = -100  # fixed value: label id the loss ignores


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def truncate(ids, max_len: int, eos_id: int | None = None, eos_inside_limit: bool = True) -> Column:
    """T3. ``eos_inside_limit``: EOS is appended first and counts toward the
    limit (text form); otherwise EOS is added after truncation (max_len + 1)."""
    ids = _c(ids)
    if eos_id is None:
        return F.slice(ids, 1, max_len)
    eos = F.array(F.lit(eos_id))
    if eos_inside_limit:
        return F.slice(F.concat(ids, eos), 1, max_len)
    return F.concat(F.slice(ids, 1, max_len), eos)


def pad_right_eos(ids, longest, eos_id: int, pad_id: int) -> tuple[Column, Column]:
    """T4: ids ‖ EOS ‖ pad up to ``longest`` + 1; mask 1 over ids and EOS."""
    ids = _c(ids)
    gap = _l(longest) - F.size(ids)
    padded = F.concat(ids, F.array(F.lit(eos_id)), F.array_repeat(F.lit(pad_id), gap))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids) + 1), F.array_repeat(F.lit(0), gap))
    return padded, mask


def pad_left(ids, longest, pad_id: int) -> tuple[Column, Column]:
    """T5: left padding to ``longest``; mask 0 over the pads."""
    ids = _c(ids)
    gap = _l(longest) - F.size(ids)
    return (F.concat(F.array_repeat(F.lit(pad_id), gap), ids),
            F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(ids))))


def pad_fixed(values, length: int, pad_value=0.0) -> tuple[Column, Column]:
    """Truncate or pad to exactly ``length``; mask 1 over real values."""
    v = F.slice(_c(values), 1, length)
    gap = F.lit(length) - F.size(v)
    return (F.concat(v, F.array_repeat(F.lit(pad_value).cast("double"), gap)),
            F.concat(F.array_repeat(F.lit(1), F.size(v)), F.array_repeat(F.lit(0), gap)))


def ones_mask(n) -> Column:
    """All-ones mask of length n."""
    return F.array_repeat(F.lit(1), _l(n))


def constant_ids(ids: list[int]) -> Column:
    """The same literal sequence on every row (no join needed)."""
    return F.array(*[F.lit(int(i)) for i in ids]).cast("array<int>")


def assemble(parts: list[Column]) -> Column:
    """Ordered concatenation of sequence parts."""
    return F.concat(*parts)


def label_ids(prefix_len, reply_ids, reply_mask) -> Column:
    """IGNORE over the prefix, reply ids where the mask is 1, else IGNORE."""
    tail = F.zip_with(_c(reply_ids), _c(reply_mask),
                      lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORE_INDEX)))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), _l(prefix_len)), tail)


def supervised_count(labels) -> Column:
    """Number of labels that are not IGNORE."""
    return F.size(F.filter(_c(labels), lambda x: x != IGNORE_INDEX))


def mask_sum(mask) -> Column:
    return F.aggregate(_c(mask), F.lit(0), lambda a, x: a + x)


def stride(values, k: int) -> Column:
    """``values[::k]``."""
    return F.filter(_c(values), lambda x, i: i % k == 0)


def downmix(audio) -> Column:
    """G1 for ``array<array<double>>`` clips: ``[n,2]`` (tested first, so 2x2 is
    frames x channels) -> mean per frame; ``[2,n]`` -> mean of the two channels;
    any other shape raises."""
    a = _c(audio)
    frames_by_two = F.forall(a, lambda f: F.size(f) == 2)
    two_by_n = (F.size(a) == 2) & (F.size(a[0]) == F.size(a[1]))
    return (F.when(frames_by_two, F.transform(a, lambda f: (f[0].cast("double") + f[1].cast("double")) / 2))
             .when(two_by_n, F.zip_with(a[0], a[1], lambda x, y: (x.cast("double") + y.cast("double")) / 2))
             .otherwise(F.raise_error(F.concat(F.lit("downmix: neither [n, 2] nor [2, n], outer length "),
                                               F.size(a).cast("string"))).cast("array<double>")))


def interleaved_to_frames(values) -> Column:
    """View a flat interleaved stereo array as ``[n/2, 2]`` frames; an empty
    clip has no frames, an odd number of samples raises."""
    v = _c(values)
    frames = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(v) / 2).cast("int") - 1, F.lit(0))),
                         lambda i: F.array(F.get(v, i * 2), F.get(v, i * 2 + 1)))
    odd = F.raise_error(F.concat(F.lit("interleaved_to_frames: odd number of samples: "), F.size(v).cast("string")))
    return F.when(F.size(v) == 0, F.slice(frames, 1, 0)).when(F.size(v) % 2 == 1, odd).otherwise(frames)


def resample_linear(values, orig_sr, target_sr: int = 16000) -> Column:
    """G2 (linear interpolation): ``n' = ceil(n * target / orig)`` samples;
    equal rates return the input unchanged."""
    v = F.transform(_c(values), lambda x: x.cast("double"))
    orig = _l(orig_sr).cast("double")
    n = F.size(v)
    n_out = F.ceil(n * F.lit(float(target_sr)) / orig).cast("int")
    step = orig / F.lit(float(target_sr))

    def sample(j):
        t = j.cast("double") * step
        i0 = F.floor(t).cast("int")
        frac = t - i0.cast("double")
        i1 = F.least(i0 + 1, n - 1)
        return F.element_at(v, i0 + 1) * (F.lit(1.0) - frac) + F.element_at(v, i1 + 1) * frac

    out = F.transform(F.sequence(F.lit(0), F.greatest(n_out - 1, F.lit(0))), sample)
    return (F.when(orig == float(target_sr), v)
             .when(n == 0, F.array().cast("array<double>"))
             .otherwise(out))


def _hex_int(hexstr: Column) -> Column:
    return F.conv(hexstr, 16, 10).cast("long")


def augment_spans(key, seed: int, n_masks: int, max_width: int, length) -> Column:
    """G9 spans: ``n_masks`` (start, width) pairs derived from
    ``md5('{seed}:{key}:{m}')`` - the same in every engine, every run."""
    def span(m):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), _c(key).cast("string"), m.cast("string")))
        start = _hex_int(F.substring(h, 1, 8)) % F.greatest(_l(length), F.lit(1))
        width = _hex_int(F.substring(h, 9, 8)) % (max_width + 1)
        return F.struct(start.alias("start"), width.alias("width"))
    return F.transform(F.sequence(F.lit(0), F.lit(n_masks - 1)), span)


def apply_mask_spans(values, spans, fill=0.0) -> Column:
    """Zero every index inside any span."""
    return F.transform(_c(values), lambda x, i: F.when(
        F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["width"])),
        F.lit(fill).cast("double")).otherwise(x.cast("double")))
