"""Marker genes and common labels of heart cell types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantell.experiment import InputError

# Marker genes per heart cell type, published lists that were partly refined by hand, in mouse spelling.
MARKERS = {
    "Art_EC": ["Rbp7", "Ly6a", "Id1", "Stmn2", "Fbln5", "Glul", "Cxcl12", "Sox17", "Hey1", "Mgll", "Dusp1", "Alpl", "Btg2", "Klf4", "Crip1"],
    "CapEC": ["Cd36", "Fabp4", "Aqp1", "Rgcc", "Gpihbp1", "Aplnr", "Lpl", "Sparcl1", "Car4", "Sparc", "Tcf15", "Sgk1", "Kdr", "Cav1", "Vwa1"],
    "VeinEC": ["Mgp", "Cfh", "Apoe", "Cpe", "Bgn", "Vwf", "Fabp5", "Vcam1", "H19", "Tmem108", "F2r", "Ptgs1", "Il6st", "Vim", "Comp"],
    "LymphEC": ["Prox1", "Lyve1", "Pdpn", "Ccl21a", "Fgl2", "Mmrn1", "Lcn2", "Nts", "Cp", "Reln", "Cd63", "Maf", "Lmo2", "Ntn1", "Anxa1"],
    "EndoEC": ["Nfatc1", "Npr3", "Nrg1", "Pecam1", "Cdh5", "Etv2"],
    "SMC": ["Myh11", "Itga8", "Acta2", "Tagln", "Carmn", "Kcnab1", "Ntrk3", "Rcan2"],
    "PC": ["Rgs5", "Abcc9", "Gucy1a2", "Egflam", "Dlc1", "Pdgfrb", "Des", "Cd248", "Mcam"],
    "FB": ["Dcn", "Abca9", "Mgp", "Lama2", "Abca6", "Gsn", "Pdgfra", "Vim", "Fap", "Pdgfrb"],
    "FBa": ["Postn"],
    "Neurons": ["Nrxn1", "Cadm2", "Chl1", "Kirrel3", "Sorcs1", "Ncam2", "Pax3"],
    "CM": ["Ryr2", "Mlip", "Ttn", "Fhl2", "Rbm20", "Ankrd1", "Tecrl", "Mybpc3", "Tnni3", "Myh7", "Mybpc3", "Irx4"],
    "B_cells": ["Igkc", "Ighm", "Aff3", "Cd74", "Bank1", "Ms4a1", "Cd79a", "Cd69"],
    "T_cells": ["Il7r", "Themis", "Skap1", "Cd247", "Itk", "Ptprc", "Camk4", "Cd3e", "Cd3d", "Cd4", "Cd8a"],
    "Myeloid": ["F13a1", "Rbpj", "Cd163", "Rbm47", "Mrc1", "Fmn1", "Msr1", "Frmd4b", "Mertk", "Lyz2"],
    "MP_recruit": ["Ccr2"],
    "MP_resident": ["Lyve1", "Timd4"],
    "ImmuneCells": ["Ptprc"],
    "Epicardial": ["Pdzrn4", "Slc39a8", "Gfpt2", "C3", "Wwc1", "Kcnt2", "Wt1", "Dpp4", "Ano1"],
    "Adip": ["Gpam", "Adipoq", "Acacb", "Ghr", "Pde3b", "Fasn", "Prkar2b", "Plin1", "Pparg"],
    "Mast": ["Il18r1", "Kit", "Slc24a3", "Ntm", "Cpa3", "Slc8a3", "Cdk15", "Hpgds", "Slc38a11", "Rab27b"],
}

# Labels of a public heart model and the common names for them.
LABELS = {
    "PC1_vent": "Pericytes",
    "SMC1_basic": "SMC",
    "SMC2_art": "SMC",
    "CD16+Mo": "Ccr2_MP",
    "LYVE1+IGF1+MP": "MP",
    "B_plasma": "B_cells",
    "B": "B_cells",
    "CD4+T_naive": "T_cells",
    "EC1_cap": "CapEC",
    "EC3_cap": "CapEC",
    "EC5_art": "ArtEC",
    "EC6_ven": "VeinEC",
    "EC7_endocardial": "EndoEC",
    "EC8_ln": "LymphEC",
    "FB3": "Fibroblasts",
    "FB4_activated": "Fibro_activ",
    "FB5": "Fibroblasts",
    "Meso": "Epi_cells",
    "vCM1": "CM",
    "Adip1": "Adip",
    "NC1_glial": "Neural",
    "LYVE1+TIMD4+MP": "MP",
    "MoMP": "MP",
    "DC": "Dendritic",
    "Mast": "Mast",
    "FB1": "Fibroblasts",
    "CD8+T_trans": "T_cells",
    "vCM4": "CM",
    "NC2_glial_NGF+": "NC_glial_NGF+",
    "NK_CD16hi": "NK",
}


def heart_markers(spark: SparkSession, species: str = "mouse", genes: DataFrame | None = None) -> DataFrame:
    """``cell_type, gene``; human names are upper case; with ``genes`` (gene_id) only those present, without regard to case."""
    if species not in ("mouse", "human"):
        raise InputError(f"{species} is not a valid species")
    pairs = [(kind, g) for kind, names in MARKERS.items() for g in dict.fromkeys(names)]
    df = spark.createDataFrame(pairs, "cell_type string, gene string")
    if genes is not None:
        known = genes.select(F.lower("gene_id").alias("__g")).distinct()
        df = df.join(known, F.lower("gene") == F.col("__g"), "left_semi")
    return df.withColumn("gene", F.upper("gene")) if species == "human" else df


def heart_labels() -> dict[str, str]:
    """The model's labels and their common names."""
    return dict(LABELS)
