"""Layouts of sections by dialect, MF and MT, in the notation of :mod:`notation`.

Variable names are those of the public format manual.  MT -1 is an MF's default.
"""

from __future__ import annotations

from . import decay
from .distributions import BY_SECTION, PRODUCTS as EMITTED

TWO_COLUMNS = """
#: ZA charge and mass number of the material as 1000 Z + A
#: AWR mass of the material in units of the neutron's mass
cont ZA AWR 0 0 0 0
#: QM energy that the reaction sets free, from masses, in eV
#: QI energy that the reaction to this level sets free, in eV
#: LR flag of a complex or breakup reaction
#: xstable cross section of the reaction by energy
#: xstable/E energies of the incident particle in eV
#: xstable/xs cross sections in barn
#: xstable/NBT last point of each range of interpolation
#: xstable/INT law of interpolation of each range
tab1 QM QI 0 LR -> xstable E xs
"""
NUBAR = """
cont ZA AWR 0 LNU 0 0
if LNU == 1
    list 0 0 0 0 NC 0
        for i = 1..NC
            vals C[i]
elif LNU == 2
    tab1 0 0 0 0 -> nubar_table Eint nubar
"""
YIELDS = """
cont ZA AWR LE+1 0 0 0
for i = 1..LE+1
    list E[i] 0 I[i] 0 NN[i] NFP[i]
        for k = 1..NFP[i]
            vals ZAFP[i,k] FPS[i,k] Y[i,k] DY[i,k]
"""
PRODUCTS = """
cont ZA AWR LIS 0 NS 0
for i = 1..NS
    section subsection[i]
        tab1 QM QI IZAP LFS -> table E sigma
"""

BASE: dict[tuple[int, int], str] = {
    **BY_SECTION,
    (8, 457): decay.DECAY,
    (34, -1): decay.ANGLE_COVARIANCES,
    (0, 0): "text TAPEDESCR{66}",
    (1, 451): """
#: ZA charge and mass number of the material as 1000 Z + A
#: AWR mass of the material in units of the neutron's mass
#: LRP whether and how resonance parameters are given in MF 2
#: LFI whether the material fissions
#: NLIB number of the library
#: NMOD number of modifications
#: ELIS energy of the target's excitation in eV
#: STA whether the target is unstable
#: LIS number of the target's state
#: LISO number of the target's isomeric state
#: NFOR version of the format
#: AWI mass of the projectile in units of the neutron's mass
#: EMAX upper limit of the energies in eV
#: LREL release of the library
#: NSUB number of the sublibrary
#: NVER version of the library
#: TEMP temperature in K for data that were broadened
#: LDRV whether the material was derived
#: NWD lines of text
#: NXC sections in the directory
#: DESCRIPTION[i] a line of the description
#: MFx[i] MF of a section in the directory
#: MTx[i] MT of a section in the directory
#: NCx[i] lines of a section in the directory
#: MOD[i] modification of a section in the directory
cont ZA AWR LRP LFI NLIB NMOD
cont ELIS STA LIS LISO 0 NFOR
cont AWI EMAX LREL 0 NSUB NVER
cont TEMP 0 LDRV 0 NWD NXC
text ZSYMAM{11} ALAB{11} EDATE{10} {1} AUTH{33}
text {1} REF{21} DDATE{10} {1} RDATE{10} {12} ENDATE{8} {3}
for i = 1..3
    text HSUB[i]
for i = 1..NWD-5
    text DESCRIPTION[i]
for i = 1..NXC
    dir MFx[i] MTx[i] NCx[i] MOD[i]
""",
    (1, 452): NUBAR,
    (1, 456): NUBAR,
    (3, -1): TWO_COLUMNS,
    (7, 2): """
cont ZA AWR LTHR 0 0 0
if LTHR == 1 or LTHR == 3
    section coherent
        tab1 T0 0 LT 0 -> S_T0_table Eint S
        for i = 1..LT
            list T[i] 0 LI 0 NP 0
                for k = 1..NP
                    vals S[k,i]
if LTHR == 2 or LTHR == 3
    tab1 SB 0 0 0 -> W_table Tint W
""",
    (7, 451): """
cont ZA AWR NA 0 0 0
for i = 1..NA
    list 0 0 NAS[i] 0 6*NI[i] NI[i]
        for k = 1..NI[i]
            vals ZAI[i,k] LISI[i,k] AFI[i,k] AWRI[i,k] SFI[i,k] 0
""",
    (8, 454): YIELDS,
    (8, 459): YIELDS,
    (8, -1): """
cont ZA AWR LIS LISO NS NO
for i = 1..NS
    section subsection[i]
        if NO == 0
            list ZAP ELFS LMF LFS 6*ND 0
                for k = 1..ND
                    vals HL[k] RTYP[k] ZAN[k] BR[k] END[k] CT[k]
        else
            cont ZAP ELFS LMF LFS 0 0
""",
    (9, -1): PRODUCTS,
    (10, -1): PRODUCTS,
    (13, -1): """
cont ZA AWR 0 0 NK 0
if NK > 1
    tab1 0 0 0 0 -> total E sigma
for i = 1..NK
    section subsection[i]
        tab1 EG ES LP LF -> table E sigma
""",
    (15, -1): """
cont ZA AWR 0 0 NC 0
for j = 1..NC
    section subsection[j]
        tab1 0 0 0 LF -> p_table E p
        tab2 0 0 0 0 NE
        for k = 1..NE
            section distribution[k]
                tab1 0 E 0 0 -> table Eg g
""",
    (23, -1): "cont ZA AWR 0 0 0 0\ntab1 EPE EFL 0 0 -> table E sigma",
    (26, -1): "stop not covered by the format's description here",
    (27, -1): "cont ZA AWR 0 0 0 0\ntab1 0 Z 0 0 -> table q H",
    (28, -1): "stop not covered by the format's description here",
    (35, -1): """
cont ZA AWR 0 0 NK 0
for k = 1..NK
    section subsection[k]
        list E1 E2 0 LB NT NE
            for i = 1..NE
                vals Ek[i]
            for i = 1..NE-1
                for j = i..NE-1
                    vals F[i,j]
""",
}

DIALECTS: dict[str, dict[tuple[int, int], str]] = {
    "endf6": BASE,
    "endf6-ext": BASE | {(4, -1): decay.OLDER_ANGLES},
    "jendl": BASE,
    "pendf": BASE
    | {
        (1, 451): decay.PROCESSED_HEAD,
        (2, 152): decay.SHIELDED,
        (2, 153): decay.PROBABILITIES,
        (3, -1): "cont ZA AWR 0 LMTR 0 0\ntab1 QM QI 0 LR -> xstable E xs",
        (23, -1): "cont ZA AWR 0 LMTR 0 0\ntab1 EPE EFL 0 0 -> table E sigma",
        # of a product whose LIP is -1 or -2 nothing follows its yields, whatever its law; a negative LIP also counts edges
        (6, -1): EMITTED.replace("        if LAW == 1\n", "        if LIP < 0 or LAW == 0\n            pass\n        elif LAW == 1\n"),
    },
    "test": decay.PROBES,
    "errorr": {
        (0, 0): BASE[0, 0],
        (1, 451): "cont ZA AWR 0 0 NW 0\nlist 0 0 NG 0 NG+1 0\n    for i = 1..NG+1\n        vals EGB[i]",
        (3, -1): "list 0 0 0 0 NG 0\n    for i = 1..NG\n        vals xs[i]",
        (33, -1): """
cont ZA AWR 0 0 0 NMT
for m = 1..NMT
    section reaction[m]
        cont 0 0 MAT1 MT1 0 NG
        repeat i = 1 until IG[i] == NG
            list 0 0 NG2[i] IG2LO[i] NG2[i] IG[i]
                for k = 1..NG2[i]
                    vals C[IG[i],k+IG2LO[i]-1]
""",
    },
}


def find(dialect: str, mf: int, mt: int) -> str | None:
    """The layout of a section, or None if it is kept as text."""
    known = DIALECTS[dialect]
    return known.get((mf, mt), known.get((mf, -1)))
