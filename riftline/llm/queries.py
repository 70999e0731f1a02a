"""The registered query of each operator, and its SQL where SQL can express it."""

from . import jaccard, mixing, mtree, packing, secrets, sharding, toxicity, urllists, vptree, wavelet

MODULES = [urllists, wavelet, packing, jaccard, vptree, mtree, toxicity, secrets, mixing, sharding]

QUERIES = {m.QUERY: m.query for m in MODULES}
ORACLES = {m.QUERY: m.ORACLE for m in MODULES if m.ORACLE}
