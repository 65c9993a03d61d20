"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import factorisation_machine, fill_middle, image_copies, line_templates, mixing, packing, personal_data, quality_rules, simhash, suffix_array, suffix_tree, vector_codes, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_image_copies": image_copies.query,
        "op2_factorisation_machine": factorisation_machine.query,
        "op3_line_templates": line_templates.query,
        "op4_source_mixing": mixing.query,
        "op5_quality_rules": quality_rules.query,
        "op6_suffix_array": suffix_array.query,
        "op7_simhash": simhash.query,
        "op8_personal_data": personal_data.query,
        "op9_suffix_tree": suffix_tree.query,
        "op10_packing": packing.query,
        "op11_warc_salvage": warc.query,
        "op12_vector_codes": vector_codes.query,
        "op13_fill_middle": fill_middle.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_templates": line_templates.ORACLE,
        "op4_source_mixing": mixing.ORACLE,
        "op11_warc_salvage": warc.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
        "op13_fill_middle": fill_middle.ORACLE,
    }
