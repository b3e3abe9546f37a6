"""Operators that prepare text for training: dedup, scans, filters, classifiers, encoding.

Nothing else in the library imports this subpackage.  Conventions that hold for every operator:
a null text counts as an empty one, only the named columns of the input are read (so further
columns, whatever their names, do no harm), and an empty table gives an empty result.
"""
