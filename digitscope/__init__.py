"""Leading-digit analysis of text corpora and numeric tables on Spark."""

from digitscope.functions.digits import analyze_number, first_digit, second_digit, with_digits
from digitscope.functions.labels import declared_category, domain_of_type, first_match_label, number_category
from digitscope.functions.markup import domain_of_text, infobox_type, strip_markup
from digitscope.functions.text import extract_categorized, extract_contexts, extract_numbers, has_number
from digitscope.operators.distribution import (
    category_conformity, chi_square_test, comparison, corpus_totals, deviation_matrix, digit_counts,
    digit_counts_map, distribution, frequencies, kolmogorov_smirnov_test, mean_absolute_deviation,
    summary, summary_sets,
)
from digitscope.operators.ranks import value_stats
from digitscope.operators.sampling import sample
from digitscope.plans.extract import build_numbers, extract, extract_articles
from digitscope.plans.preview import preview
from digitscope.plans.report import analyze, write_report

__all__ = [
    "analyze", "analyze_number", "build_numbers", "category_conformity", "chi_square_test", "comparison",
    "corpus_totals", "declared_category", "deviation_matrix", "digit_counts", "digit_counts_map", "distribution", "domain_of_text",
    "domain_of_type", "extract", "extract_articles", "extract_categorized", "extract_contexts",
    "extract_numbers", "first_digit", "first_match_label", "frequencies", "has_number", "infobox_type",
    "kolmogorov_smirnov_test", "mean_absolute_deviation", "number_category", "preview", "sample",
    "second_digit", "strip_markup", "summary", "summary_sets", "value_stats", "with_digits", "write_report",
]
