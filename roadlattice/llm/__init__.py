"""Training-data operators over text corpora; nothing else in the package imports this."""

from pyspark import cloudpickle

from . import bpe_kernel, codes_kernel, html_kernel, kernels, langid_kernel, packing_kernel, runs_kernel, toxicity_kernel, warc_kernel, wu_manber

# Executors get the task helpers with the task, so they need no installed copy of this package.
for _module in (bpe_kernel, codes_kernel, html_kernel, kernels, langid_kernel, packing_kernel, runs_kernel, toxicity_kernel, warc_kernel, wu_manber):
    cloudpickle.register_pickle_by_value(_module)
