"""Layouts of decay data, covariances of angles, and what processed and older libraries lay out in their own way.

Variable names are those of the public format manual.
"""

from __future__ import annotations

#: Radioactive decay; a line's list has six values, and as many more as its length says.
DECAY = """
cont ZA AWR LIS LISO NST NSP
if NST == 0
    list THALF DTHALF 0 0 2*NC 0
        for k = 1..NC
            vals EX[k] DEX[k]
    list SPI PAR 0 0 6*NDK NDK
        for k = 1..NDK
            vals RTYP[k] RFS[k] Q[k] DQ[k] BR[k] DBR[k]
    for k = 1..NSP
        section spectrum[k]
            list 0 STYP LCON LCOV 6 NER
                vals FD DFD ERAV DERAV FC DFC
            if LCON != 1
                for i = 1..NER
                    section line[i]
                        list ER DER 0 0 NT 0
                            vals RTYP TYPE RI DRI
                            if NT >= 6
                                vals RIS DRIS
                            if NT >= 8
                                vals RICC DRICC
                            if NT >= 10
                                vals RICK DRICK
                            if NT >= 12
                                vals RICL DRICL
            if LCON != 0
                tab1 RTYP 0 0 0 -> continuum E RP
                if LCOV == 1 or LCOV == 3
                    section continuum_covariance
                        list 0 0 0 2 2*NPP NPP
                            for m = 1..NPP
                                vals E[m] F[m]
            if LCOV == 2 or LCOV == 3
                section line_covariance
                    list 0 0 LS 5 NE NERP
                        for m = 1..NERP
                            vals E[m]
                        for m = 1..NERP-1
                            for n = m..NERP-1
                                vals F[m,n]
else
    list 0 0 0 0 6 0
        vals 0 0 0 0 0 0
    list SPI PAR 0 0 6 0
        vals 0 0 0 0 0 0
"""

_BLOCK = """
section block[n]
    cont 0 0 L L1 LCT NI
    for m = 1..NI
        section matrix[m]
            list 0 0 LS LB NT NE
                for q = 1..NT
                    vals F[q]
"""


def _within(depth: int, text: str) -> str:
    return "\n".join("    " * depth + row for row in text.strip().split("\n"))


#: Covariances of angular distributions; MT is the section's own, of its control fields.
ANGLE_COVARIANCES = f"""
cont ZA AWR 0 LTT 0 NMT1
for k = 1..NMT1
    section subsection[k]
        cont 0 0 MAT1 MT1 NL NL1
        if MT1 == 0 or MT1 == MT
            for n = 1..NL*(NL+1)/2
{_within(4, _BLOCK)}
        else
            for n = 1..NL*NL1
{_within(4, _BLOCK)}
"""

_LEGENDRE = """
for i = {first}..{last}
    list T[i] E[i] LT[i] 0 NL[i] 0
        for l = 1..NL[i]
            vals a[i,l]
"""
_TABULATED = """
for i = {first}..{last}
    section distribution[i]
        tab1 T E LT 0 -> table mu f
"""
#: Angular distributions with the transformation matrix that older libraries hold.
OLDER_ANGLES = f"""
cont ZA AWR LVT LTT 0 0
if LVT > 0
    list 0 AWR? LI LCT NK NM
        for k = 1..NK
            vals V[k]
else
    cont 0 AWR? LI LCT 0 NM
if LTT == 1 and LI == 0
    tab2 0 0 0 0 NE -> leg_int
{_within(1, _LEGENDRE.format(first="1", last="NE"))}
elif LTT == 2 and LI == 0
    tab2 0 0 0 0 NE -> ang_int
{_within(1, _TABULATED.format(first="1", last="NE"))}
elif LTT == 3 and LI == 0
    tab2 0 0 0 0 NE1 -> leg_int
{_within(1, _LEGENDRE.format(first="1", last="NE1"))}
    tab2 0 0 0 0 NE2 -> ang_int
{_within(1, _TABULATED.format(first="NE1", last="NE1+NE2-1"))}
"""


def _bins(names: str, count: str) -> str:
    """Each of the names for all bins of an energy."""
    return "\n".join(f"            for j = 1..{count}\n                vals {n}[i,j]" for n in names.split())


#: Unresolved cross sections by background, and probability tables, as processing writes them.
SHIELDED = f"""
cont ZA AWR LSSF 0 0 INTUNR
let NW = NSIGZ+NUNR*(1+5*NSIGZ)
list TEMZ 0 5 NSIGZ N NUNR
    if N == NW
        for j = 1..NSIGZ
            vals SIGZ[j]
        for i = 1..NUNR
            vals EUNR[i]
{_bins("STOT SELAS SFIS SCAP STRN", "NSIGZ")}
"""
PROBABILITIES = f"""
cont ZA AWR IINEL IABSO INTUNR NBIN
list TEMZ 0 LSSF 0 N NUNR
    if N == (1+6*NBIN)*NUNR
        for i = 1..NUNR
            vals EUNR[i]
{_bins("PROB TOTL ELAS FISS CAPT HEAT", "NBIN")}
"""
PROCESSED_HEAD = """
cont ZA AWR LRP LFI NLIB NMOD
cont ELIS STA LIS LISO 0 NFOR
cont AWI EMAX LREL 0 NSUB NVER
cont TEMP TOL LDRV 0 NWD NXC
for i = 1..NWD
    text DESCRIPTION[i]
for i = 1..NXC
    dir MFx[i] MTx[i] NCx[i] MOD[i]
"""

#: Probes of nested indices.
PROBES = {
    (1, 1): "cont 0 0 A[1] A[2] B[1] B[2]\ncont 0 0 C[1] C[2] 0 0\ncont 0 0 B[A[1]-8] C[B[A[1]-8]+0] 0 0",
    (1, 2): "cont 0 0 A[1] A[2] B[1] B[2]\ncont 0 0 C[1] C[2] 0 0\nif B[A[1]-8] == B[1]\n    cont 0 0 B[A[1]-8] C[B[A[1]-8]+0] 0 0",
    (1, 3): "cont 0 0 A[1] A[2] B[1] B[2]\ncont 0 0 C[1] C[2] 0 0\nfor i = B[A[1]-8]..B[1]\n    cont 0 0 B[A[1]-8] C[B[A[1]-8]+0] 0 0",
}
